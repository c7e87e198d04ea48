"""Small catalog operators: shown metadata, playable songs, choices among sources, digests, publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions.text import trimmed
from tessitura.functions.titles import cleaned_artist
from tessitura.sources import publish as versions


def safe_metadata(songs: DataFrame, limit: int = 400) -> DataFrame:
    """What guests see of songs: id, title, track, artist, duration. Names are trimmed and of at most `limit` letters; an
    empty title is the track, else a placeholder, an empty track the title."""
    cut = lambda c: F.left(trimmed(F.col(c)), F.lit(limit))
    title = F.coalesce(F.nullif(cut("title"), F.lit("")), F.nullif(cut("track"), F.lit("")), F.lit("Untitled song"))
    return songs.select("id", title.alias("title"), F.coalesce(F.nullif(cut("track"), F.lit("")), title).alias("track"), cut("artist").alias("artist"), F.col("duration").cast("double").alias("duration"))


def playable(songs: DataFrame) -> DataFrame:
    """Finished songs that have an instrumental."""
    return songs.where("state = 'done' AND coalesce(instrumental, '') <> ''")


def keep_artist(jobs: DataFrame) -> DataFrame:
    """Plans (artist, track, planned_artist, planned_track, changed) in which a stored artist that cleaning leaves anything of
    stays: its cleaned form replaces a planned artist that is neither it nor the stored one. changed is then anew."""
    now, planned = trimmed(F.col("artist")), F.coalesce("planned_artist", F.lit(""))
    clean = cleaned_artist(now)
    keeps = (now != "") & (clean != "") & (planned != now) & (planned != clean)
    track = F.nullif(trimmed(F.col("track")), F.lit(""))
    moved = ~F.nullif(F.col("planned_track"), F.lit("")).eqNullSafe(track) | (clean != now)
    return jobs.withColumns({"planned_artist": F.when(keeps, clean).otherwise(F.col("planned_artist")), "changed": F.when(keeps, moved).otherwise(F.col("changed"))})


def to_maintain(songs: DataFrame, most_lines: int | None = None, without_artist: bool = False, limit: int | None = None) -> DataFrame:
    """Finished songs that a maintenance run takes: all, those of at most so many lines (unknown is none), or those without an artist; by id, at most `limit`."""
    rows = songs.where("state = 'done'")
    if most_lines is not None:
        rows = rows.where(F.coalesce("line_count", F.lit(0)) <= most_lines)
    if without_artist:
        rows = rows.where(trimmed(F.col("artist")) == "")
    return rows if limit is None else rows.orderBy("id").limit(limit)


def queued_markers(songs: DataFrame, queue: DataFrame) -> DataFrame:
    """Songs with whether a queue holds them."""
    held = queue.select(F.col("job_id").alias("id"), F.lit(True).alias("_q")).distinct()
    return songs.join(held, "id", "left").withColumn("queued", F.coalesce("_q", F.lit(False))).drop("_q")


def collated(rows: DataFrame, column: str, locale: str = "zh") -> DataFrame:
    """Rows in a locale's order: for zh Han by pinyin, before Latin."""
    return rows.orderBy(F.collate(F.col(column), locale), column)


def first_match(rows: DataFrame, directory: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A value by the first key that finds one: an equi-join for each key."""
    out, names = rows, []
    for key in keys:
        own = directory.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(f"_{key}"))
        out, names = out.join(own, key, "left"), [*names, f"_{key}"]
    return out.withColumn(value, F.coalesce(*names)).drop(*names)


def lyric_source(rows: DataFrame, order: list[str]) -> DataFrame:
    """The first of several sources that has lines, with its name: for instance database, subtitles, recognition."""
    choice = F.coalesce(*(F.when(F.size(F.coalesce(F.col(c), F.array())) > 0, F.struct(F.lit(c).alias("source"), F.col(c).alias("lines"))) for c in order))
    return rows.withColumn("_c", choice).withColumn("source", F.col("_c.source")).withColumn("lines", F.col("_c.lines")).drop("_c", *order)


def timed_or_plain(rows: DataFrame) -> DataFrame:
    """synced if there is any, else plain, else an error."""
    kind = F.when(F.coalesce("synced", F.lit("")) != "", "synced").when(F.coalesce("plain", F.lit("")) != "", "plain").otherwise("error")
    return rows.withColumn("kind", kind)


def same_source(cached: Column, now: Column, value: Column, fallback: Column) -> Column:
    """A cached value while its identity is the same; unknown equals unknown."""
    return F.when(cached.eqNullSafe(now), value).otherwise(fallback)


def digests(rows: DataFrame, key: str, content: str) -> DataFrame:
    """SHA-256 and size of each content."""
    return rows.select(key, F.sha2(F.col(content), 256).alias("sha256"), F.octet_length(F.coalesce(F.col(content), F.lit(""))).cast("long").alias("size"))


def publish(group: DataFrame, folder: str, name: str, generation: int = 0, expected: int | None = None) -> int:
    """Publish a group of artifacts as the next version of its name, fenced as in `sources.publish`; readers see the old version or the new one, whole."""
    return versions.publish(group, f"{folder}/{name}", generation, expected, "parquet")


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The newest published version."""
    return spark.read.parquet(versions.published(spark, f"{folder}/{name}"))


def archive_outcome(files: DataFrame) -> DataFrame:
    """What archiving does with each file (library, library_there, source_there, name, target_there, same_file, error), without replacing another.

    disabled without a library, failed if it or the source is not there, skipped without a name, archived if it is there
    already, conflict with another file of that name, failed if moving failed, else archived.
    """
    outcome = (
        F.when(F.coalesce("library", F.lit("")) == "", "disabled")
        .when(~F.col("library_there") | ~F.col("source_there"), "failed")
        .when(F.coalesce("name", F.lit("")) == "", "skipped")
        .when(F.col("target_there") & F.col("same_file"), "archived")
        .when(F.col("target_there"), "conflict")
        .when(F.col("error").isNotNull(), "failed")
        .otherwise("archived")
    )
    return files.withColumn("outcome", outcome)
