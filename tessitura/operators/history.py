"""Play history: upserts as folds over an event log, retention, rankings and pages.

Every key, window and join is led by the account, so no account sees another's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that an account retains; rows of a page and the largest page.
RETAINED, PAGE, LARGEST_PAGE = 500, 50, 100


def upsert_plays(events: DataFrame) -> DataFrame:
    """Fold confirmed plays by (account_id, play_key).

    The first event (smallest id) gives id, started_at, job_id and the song's names; the last gives the
    device and updated_at; position and completed only grow. Partial aggregates run before the shuffle.
    """
    first = [c for c in ("job_id", "title", "artist", "duration") if c in events.columns]
    last = [c for c in ("device_id", "device_label") if c in events.columns]
    return events.groupBy("account_id", "play_key").agg(
        F.min("id").alias("id"),
        F.min_by("started_at", "id").alias("started_at"),
        F.max_by("started_at", "id").alias("updated_at"),
        F.max(F.greatest("position", F.lit(0.0))).alias("position"),
        F.bool_or("completed").alias("completed"),
        *(F.min_by(c, "id").alias(c) for c in first),
        *(F.max_by(c, "id").alias(c) for c in last),
    )


def complete_plays(history: DataFrame, ended: DataFrame) -> DataFrame:
    """Mark plays that an `ended` row (account_id, play_key, at, position) names; rows without one are never made."""
    done = ended.groupBy("account_id", "play_key").agg(F.max("at").alias("_at"), F.max(F.greatest("position", F.lit(0.0))).alias("_position"))
    return (
        history.join(done, ["account_id", "play_key"], "left")
        .withColumn("completed", F.col("completed") | F.col("_at").isNotNull())
        .withColumn("updated_at", F.coalesce("_at", "updated_at"))
        .withColumn("position", F.greatest("position", "_position"))
        .drop("_at", "_position")
    )


def retain(history: DataFrame, limit: int = RETAINED, key: str = "account_id") -> DataFrame:
    """The newest rows of each account: a ranked window that Spark cuts before the shuffle."""
    newest = Window.partitionBy(key).orderBy(F.col("id").desc())
    return history.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= limit).drop("_n")


def ranking(history: DataFrame, limit: int = RETAINED) -> DataFrame:
    """Plays and last play of each account's songs; the best `limit` by plays, last play, then song id."""
    songs = history.where("job_id <> ''").groupBy("account_id", "job_id").agg(F.count(F.lit(1)).alias("plays"), F.max("started_at").alias("last_played_at"))
    order = Window.partitionBy("account_id").orderBy(F.col("plays").desc(), F.col("last_played_at").desc(), "job_id")
    return songs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def ranking_totals(ranked: DataFrame) -> DataFrame:
    """Plays of the listed songs of each account."""
    return ranked.groupBy("account_id").agg(F.sum("plays").alias("total_plays"), F.count(F.lit(1)).alias("songs"))


def with_device_label(history: DataFrame, devices: DataFrame) -> DataFrame:
    """Left join on (account_id, device_id); a current label that is not empty replaces the stored one."""
    current = devices.select("account_id", "device_id", F.col("label").alias("_current"))
    shown = F.coalesce(F.expr("nullif(_current, '')"), F.col("device_label"))
    return history.join(current, ["account_id", "device_id"], "left").withColumn("device_label", shown).drop("_current")


def page(history: DataFrame, account: str, limit: int = PAGE, before: int | None = None) -> DataFrame:
    """One page, newest first, with next_before set on its rows when more follow.

    The limit is the page: one row more than its size is fetched to see whether it is the last.
    """
    size = max(1, min(int(limit), LARGEST_PAGE))
    rows = history.where(F.col("account_id") == F.lit(account))
    if before is not None:
        rows = rows.where(F.col("id") < before)
    fetched = rows.orderBy(F.col("id").desc()).limit(size + 1)
    everything = Window.orderBy(F.col("id").desc())  # at most size + 1 rows
    fetched = fetched.withColumn("_n", F.row_number().over(everything)).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy()))
    kept = fetched.where(F.col("_n") <= size)
    last = F.min("id").over(Window.partitionBy())
    return kept.withColumn("next_before", F.when(F.col("_all") > size, last)).drop("_n", "_all")


def delete_entries(history: DataFrame, gone: DataFrame) -> DataFrame:
    """Delete by (account_id, id); an entry of another account stays."""
    return history.join(gone.select("account_id", "id").distinct(), ["account_id", "id"], "left_anti")


def clear(history: DataFrame, accounts: DataFrame) -> DataFrame:
    """Delete all rows of the given accounts."""
    return history.join(accounts.select("account_id").distinct(), "account_id", "left_anti")


def counts(history: DataFrame) -> DataFrame:
    """Rows of each account."""
    return history.groupBy("account_id").agg(F.count(F.lit(1)).alias("total"))


def occupied(members: DataFrame, account: str = "account_id", room: str = "room_id") -> DataFrame:
    """Exact numbers of distinct accounts and rooms."""
    return members.agg(F.countDistinct(account).alias("accounts"), F.countDistinct(room).alias("rooms"))


def keep_newest(log: DataFrame, key: list[str], order: str, limit: int, where: str = "true") -> DataFrame:
    """Bound a log: of the rows that `where` selects the newest `limit` of each key stay, all others stay untouched."""
    w = Window.partitionBy(*key, F.expr(where)).orderBy(F.col(order).desc())
    return log.withColumn("_n", F.row_number().over(w)).where(F.expr(f"NOT ({where}) OR _n <= {limit}")).drop("_n")


def latest_match(rows: DataFrame, key: str, order: list, states: list[str] | None = None) -> DataFrame:
    """The newest row of each key, of the given states only if any are given."""
    rows = rows if states is None else rows.where(F.col("state").isin(states))
    fields = F.struct(*[c for c in rows.columns if c != key])
    return rows.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.max_by(fields, F.struct(*order)).alias("_r")).select(key, "_r.*")


def valid_statistics(replies: DataFrame) -> DataFrame:
    """Replies (account_id, asked_by, songs, total_plays, history_limit) with what is wrong: nothing, "invalid", or "account changed"."""
    good = F.col("songs").isNotNull() & (F.col("total_plays") >= 0) & (F.col("history_limit") >= 1) & (F.size("songs") <= F.col("history_limit"))
    wrong = F.when(~F.coalesce(good, F.lit(False)), "invalid").when(~F.col("account_id").eqNullSafe(F.col("asked_by")), "account changed")
    return replies.withColumn("wrong", wrong)
