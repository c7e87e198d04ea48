"""Importing listings: states against the catalog, reuse, summaries, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions.states import ACTIVE, PENDING

from .history import latest_match

IMPORTABLE = ("new", "failed")
LONGEST_SECONDS = 900


def newest(jobs: DataFrame, key: str, states: list[str] | None = None) -> DataFrame:
    """The newest job of each key (ties by id), of some states only if given."""
    return latest_match(jobs, key, ["created_at", "id"], states)


def status_of(state: Column) -> Column:
    """new without a job; only queued and running jobs are pending, all but finished ones else have failed."""
    return F.when(state.isNull(), "new").when(state == "done", "done").when(state.isin(*PENDING), "pending").otherwise("failed")


def duration_ok(duration: Column, longest: float = LONGEST_SECONDS) -> Column:
    """Unknown and non-finite lengths pass."""
    return duration.isNull() | F.isnan(duration) | (F.abs(duration) == F.lit(float("inf"))) | (duration <= longest)


def listing_status(entries: DataFrame, jobs: DataFrame, longest: float = LONGEST_SECONDS) -> DataFrame:
    """Entries of a listing with their state: unavailable, too long, else that of the newest job of the same video."""
    last = newest(jobs.where("video_id <> ''").select("video_id", "id", "state", "created_at"), "video_id").select("video_id", F.col("id").alias("job_id"), F.col("state").alias("job_state"))
    status = F.when(F.coalesce("unavailable", F.lit(False)), "unavailable").when(~duration_ok(F.col("duration"), longest), "too_long").otherwise(status_of(F.col("job_state")))
    return entries.join(last, "video_id", "left").withColumn("status", status)


def local_status(entries: DataFrame, jobs: DataFrame) -> DataFrame:
    """Files with the state of the newest job of their video, else of their path: two equi-joins, no OR."""
    by_video = newest(jobs.where("video_id <> ''").select("video_id", "id", "state", "created_at"), "video_id").select("video_id", F.col("id").alias("_v"), F.col("state").alias("_vs"))
    by_path = newest(jobs.where("local_path <> ''").select(F.col("local_path").alias("path"), "id", "state", "created_at"), "path").select("path", F.col("id").alias("_p"), F.col("state").alias("_ps"))
    met = entries.join(by_video, "video_id", "left").join(by_path, "path", "left")
    return met.withColumn("job_id", F.coalesce("_v", "_p")).withColumn("status", status_of(F.coalesce("_vs", "_ps"))).drop("_v", "_vs", "_p", "_ps")


def importable(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("status").isin(*IMPORTABLE))


def selected(entries: DataFrame, key: str, wanted: list | None) -> DataFrame:
    """Entries whose key is wanted; None takes all."""
    return entries if wanted is None else entries.where(F.col(key).isin(wanted))


def summary(entries: DataFrame, column: str = "status") -> DataFrame:
    """Entries of each state."""
    return entries.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def create_or_reuse(requests: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests that need a new job, requests with the newest active or finished job of their video or path). Blank videos and paths are those of nothing."""
    live = jobs.where(F.col("state").isin(*ACTIVE, "done")).select("id", "video_id", F.col("local_path").alias("path"), "created_at")
    # of a video's or path's jobs only the newest can be the answer, so a request meets two rows at most
    last = lambda key: live.where(F.col(key) != "").groupBy(key).agg(F.max(F.struct("created_at", "id")).alias("_l")).select(key, "_l.*")
    found = [requests.join(last(key), key).select("request_id", "id", "created_at") for key in ("video_id", "path")]
    reused = found[0].unionByName(found[1]).groupBy("request_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("job_id"))
    return requests.join(reused, "request_id", "left_anti"), reused


def distinct_entries(entries: DataFrame, key: str, order: str) -> DataFrame:
    """The first entry of each key, in listing order."""
    fields = F.struct(*[c for c in entries.columns if c != key])
    return entries.groupBy(key).agg(F.min_by(fields, order).alias("_r")).select(key, "_r.*")


def truncated(entries: DataFrame, order: str, limit: int) -> DataFrame:
    """At most `limit` entries of a listing, which is the listing's size, with a flag whether there were more."""
    more = entries.orderBy(order).limit(limit + 1)
    n = more.count()
    return more.orderBy(order).limit(limit).withColumn("truncated", F.lit(n > limit))


def manifest_check(declared: DataFrame, expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Tasks with whether their files are the expected ones, each once, with the stored sizes and digests."""
    own = declared.groupBy("task_id", "role").agg(F.count(F.lit(1)).alias("times"), F.first("size").alias("size"), F.first("sha256").alias("sha256"))
    met = own.join(expected.select("task_id", "role", F.lit(True).alias("wanted")), ["task_id", "role"], "full_outer").join(
        stored.select("task_id", "role", F.col("size").alias("has_size"), F.col("sha256").alias("has_sha256")), ["task_id", "role"], "left"
    )
    fine = F.coalesce((F.col("times") == 1) & F.col("wanted") & (F.col("size") == F.col("has_size")) & (F.col("sha256") == F.col("has_sha256")), F.lit(False))
    return met.groupBy("task_id").agg(F.bool_and(fine).alias("ok"), F.count_if(~fine).alias("problems"))


def stems_agree(stems: DataFrame) -> DataFrame:
    """Whether a task's stems last equally long, within a quarter second or one percent."""
    spread = F.max("duration") - F.min("duration")
    return stems.groupBy("task_id").agg((spread <= F.greatest(F.lit(0.25), F.max("duration") * 0.01)).alias("ok"))


def rename_plan(files: DataFrame) -> DataFrame:
    """What a renaming would do to each file (id, path, target): missing, same (also without a target), clash with a file that is there, or renamed."""
    there = files.select(F.col("path").alias("_e")).where("_e is not null").distinct()
    met = files.join(there, F.col("target") == F.col("_e"), "left")
    plan = (
        F.when(F.col("path").isNull(), "missing")
        .when((F.coalesce("target", F.lit("")) == "") | (F.col("path") == F.col("target")), "same")
        .when(F.col("_e").isNotNull(), "clash")
        .otherwise("renamed")
    )
    return met.withColumn("plan", plan).drop("_e")


def skipped(entries: DataFrame, column: str = "status") -> DataFrame:
    """Entries that are not imported, with the reason: their state."""
    return entries.where(~F.col(column).isin(*IMPORTABLE)).withColumn("reason", F.col(column))
