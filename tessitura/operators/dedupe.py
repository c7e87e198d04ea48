"""Versions of one song: grouping by a normalized key and choosing the best."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions.text import dedupe_key

#: Quality scores this close count as equal.
TIE = 4.0


def duplicate_groups(songs: DataFrame) -> DataFrame:
    """Finished songs that share normalized artist and track with another, with the size of their group."""
    keyed = songs.where("state = 'done'").withColumn("artist_key", dedupe_key(F.col("artist"))).withColumn("track_key", dedupe_key(F.col("track")))
    keyed = keyed.where("track_key <> ''")
    size = keyed.groupBy("artist_key", "track_key").agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return keyed.join(size, ["artist_key", "track_key"])


def measurable(groups: DataFrame, error: str = "error") -> DataFrame:
    """Groups in which every version could be measured; one failure keeps the whole group as it is."""
    failed = groups.where(F.col(error).isNotNull()).select("artist_key", "track_key").distinct()
    return groups.join(failed, ["artist_key", "track_key"], "left_anti")


def ranked_versions(groups: DataFrame, key: list[str], tie: float = TIE) -> DataFrame:
    """Place of each version: those within `tie` of the group's best quality first, by lines, quality, then id."""
    top = F.max("q").over(Window.partitionBy(*key))
    tier = F.when(F.col("q") >= F.col("_top") - tie, 0).otherwise(1)
    order = Window.partitionBy(*key).orderBy("tier", F.col("lines").desc(), F.col("q").desc(), "id")
    return groups.withColumn("_top", top).withColumn("tier", tier).withColumn("place", F.row_number().over(order)).drop("_top")


def totals(ranked: DataFrame, key: list[str], size: str | None = None) -> DataFrame:
    """Groups, versions, those to drop, and their bytes."""
    drop = F.col("place") > 1
    return ranked.agg(
        F.count_if(F.col("place") == 1).alias("groups"),
        F.count(F.lit(1)).alias("versions"),
        F.count_if(drop).alias("dropped"),
        F.sum(F.when(drop, F.col(size) if size else F.lit(0)).otherwise(0)).cast("long").alias("freed"),
    )


def unmeasured(songs: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """Songs whose key (id, file, modification time, size) has no measurement yet."""
    return songs.join(cache.select(*key).distinct(), key, "left_anti")


def largest_first(groups: DataFrame) -> DataFrame:
    """Groups by size, the largest first; equal ones by their keys."""
    return groups.select("artist_key", "track_key", "group_size").distinct().orderBy(F.col("group_size").desc(), "artist_key", "track_key")
