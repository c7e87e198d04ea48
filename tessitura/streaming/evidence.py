"""Confirmed playback from player reports: one fold, used by a batch operator and a stateful stream.

A window of playing opens with a report and grows while reports keep playing and the position keeps up with
the clock. Anything else (another state, an older position, a jump ahead of the clock, another generation)
opens a new one. A play is confirmed once media and clock both advanced by three seconds, then at
most every ten. Reports of an old item or generation are rejected by that, not by their time, so no watermark
decides what counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVIDENCE_MS, REFRESH_MS, LEASE_MS, PRESENCE_MS = 3000, 10_000, 12_000, 30_000

CONFIRMED = "key string, generation int, at_ms long, position_ms long"
_STATE = "generation int, from_ms long, since_ms long, told_ms long"


def observe(state: tuple | None, report: tuple) -> tuple[tuple | None, bool]:
    """(state after a report, whether the report confirms a play).

    state: generation, position where the window opened (None: none is open), clock then, clock of the last
    confirmation (None: none yet). report: generation, clock, position, status.
    """
    generation, now, position, status = report
    if status != "playing":
        return (state and (state[0], None, state[2], state[3])), False
    if state is None or state[0] != generation:
        return (generation, position, now, state[3] if state else None), False
    _, opened, since, told = state
    reopened = (generation, position, now, told)
    if opened is None or position < opened:
        return reopened, False
    media, clock = position - opened, now - since
    if media > clock + EVIDENCE_MS:
        return reopened, False
    due = told is None or now - told >= REFRESH_MS
    if min(media, clock) < EVIDENCE_MS or not due:
        return state, False
    return (generation, opened, since, now), True


def accepted(reports: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports of the room's current item and generation with a finite position, all others)."""
    met = reports.join(current.select("room_id", F.col("item_id").alias("_i"), F.col("generation").alias("_g")), "room_id", "left")
    good = F.coalesce((F.col("current_id") == F.col("_i")) & (F.col("generation") == F.col("_g")) & ~F.isnan("position") & (F.abs("position") < float("inf")), F.lit(False))
    tagged = met.withColumn("_ok", good).drop("_i", "_g")
    return tagged.where("_ok").drop("_ok"), tagged.where("NOT _ok").drop("_ok")


def _none(value):
    return None if value is None or value != value else int(value)


def confirmed(reports: DataFrame) -> DataFrame:
    """Confirming reports (key, generation, at_ms, position_ms, status; id orders equal times): a fold over each key in order of time."""

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        state, out = None, []
        frame = frame.sort_values(["at_ms", "id"])
        for g, at, position, status in zip(frame["generation"], frame["at_ms"], frame["position_ms"], frame["status"], strict=True):
            state, yes = observe(state, (int(g), int(at), int(position), status))
            if yes:
                out.append((key[0], int(g), int(at), int(position)))
        return pd.DataFrame(out, columns=[f.split()[0] for f in CONFIRMED.split(", ")])

    return reports.select("key", "generation", "at_ms", "position_ms", "status", "id").groupBy("key").applyInPandas(run, CONFIRMED)


class EvidenceProcessor(StatefulProcessor):
    """The same fold as keyed state of a stream; with `idle_ms` a key that reports nothing for so long is dropped."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", _STATE, *([self.idle_ms] if self.idle_ms else []))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = tuple(map(_none, self.state.get())) if self.state.exists() else None
        out = []
        frame = pd.concat(list(rows)).sort_values(["at_ms", "id"])
        for g, at, position, status in zip(frame["generation"], frame["at_ms"], frame["position_ms"], frame["status"], strict=True):
            state, yes = observe(state, (int(g), int(at), int(position), status))
            if yes:
                out.append((key[0], int(g), int(at), int(position)))
        if state is not None:
            self.state.update(state)
        yield pd.DataFrame(out, columns=[f.split()[0] for f in CONFIRMED.split(", ")])

    def close(self) -> None:
        pass


def confirmed_stream(reports: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """A stream of confirmations. Needs the RocksDB state store (see `use_rocksdb`).

    Dropping idle keys takes processing time, under which a stream keeps running batches: leave it out where
    a trigger is to end by itself.
    """
    cols = reports.select("key", "generation", "at_ms", "position_ms", "status", "id")
    return cols.groupBy("key").transformWithStateInPandas(EvidenceProcessor(idle_ms), CONFIRMED, "append", "processingTime" if idle_ms else "none")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def leases(reports: DataFrame, now_ms: int) -> DataFrame:
    """Last report of each key: still playing only if its lease is not over; else its position stays as last told."""
    fields = F.struct("at_ms", "position_ms", "status")
    last = reports.groupBy("key").agg(F.max_by(fields, F.struct("at_ms", "id")).alias("r")).select("key", "r.*")
    held = F.lit(now_ms) - F.col("at_ms") < LEASE_MS
    return last.withColumn("held", held).withColumn("playing", held & (F.col("status") == "playing"))


def live_devices(reports: DataFrame, now_ms: int) -> DataFrame:
    """Keys seen within the presence time, as a stream's time-to-live state would hold them."""
    return reports.groupBy("key").agg(F.max("at_ms").alias("seen_ms")).where(F.lit(now_ms) - F.col("seen_ms") < PRESENCE_MS)


def dedupe_commands(commands: DataFrame, time: str = "at", delay: str = "1 hour") -> DataFrame:
    """A stream of commands, each id once within the watermark."""
    return commands.withWatermark(time, delay).dropDuplicatesWithinWatermark(["room_id", "command_id"])
