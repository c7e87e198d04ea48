"""Catalog, play, lyric and event tables made from the analytic test tables, by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def seconds(ts: str = "ts"):
    """Epoch seconds as a double."""
    return F.unix_micros(F.col(ts).cast("timestamp")).cast("double") / F.lit(1e6)


def plays(spark: SparkSession, folder: str) -> DataFrame:
    """History rows from events: a user is an account, props.k a song, a purchase a completed play."""
    job = F.coalesce(F.regexp_extract("props", r'"k": ?(-?\d+)', 1), F.lit(""))
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("account_id"),
        F.concat_ws(":", F.col("user_id").cast("string"), job, F.date_format("ts", "yyyy-MM-dd")).alias("play_key"),
        job.alias("job_id"),
        seconds().alias("started_at"),
        F.col("value").alias("position"),
        (F.col("event_type") == "purchase").alias("completed"),
        F.col("event_type").alias("device_id"),
    )


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Songs from documents: the first line is the title, the source the artist; labels decide the state."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    state = F.when(F.col("quality") == 1, "done").when(F.col("quality") == 0, "error").otherwise("queued")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.split("text", "\n").getItem(0).alias("title"),
        F.col("source").alias("artist"),
        F.col("lang").alias("language"),
        (F.col("n_chars") / 10.0).alias("duration"),
        state.alias("state"),
        (F.size(F.split("text", "\n")) - 1).alias("line_count"),
    )


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Timed lines from conversations: each turn starts where the lengths of the earlier ones end, in ms."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("job_id"),
        F.col("turn").alias("line_no"),
        F.col("role").alias("singer"),
        F.col("text"),
        F.coalesce(F.sum(F.length("text") * 100).over(w), F.lit(0)).cast("long").alias("start_ms"),
    )


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """Song versions from parts: brand is the artist, name the track, price the quality, size the lines."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("artist"), F.col("p_name").alias("track"), F.col("p_retailprice").alias("q"), F.col("p_size").alias("lines"), F.lit("done").alias("state")
    )


def heartbeats(spark: SparkSession, folder: str) -> DataFrame:
    """Player reports from events: errors are blocked, clicks paused, the rest playing."""
    status = F.when(F.col("event_type") == "error", "blocked").when(F.col("event_type") == "click", "paused").otherwise("playing")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("key"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"),
        F.round(F.col("value") * 1000).cast("long").alias("position_ms"),
        status.alias("status"),
    )
