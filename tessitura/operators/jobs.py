"""Jobs, trials and operations as event-sourced state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.functions.clock import trial_expiry
from tessitura.functions.states import TERMINAL

JOB_STATE = "job_id string, state string, generation int, progress int, accepted int, refused int"


def fold_job(events: list[dict]) -> dict:
    """A job after its events (action, generation, state, progress): work of an old generation is refused.

    create queues; update needs the current generation and a job that is not over; retry queues a failed or
    cancelled one anew under the next generation; cancel ends an open one; delete ends all.
    """
    s = {"state": None, "generation": 0, "progress": 0, "accepted": 0, "refused": 0}
    for e in events:
        action, ok = e["action"], False
        if action == "create":
            ok = s["state"] in (None, "deleted")
            if ok:
                s |= {"state": "queued", "generation": s["generation"] + 1, "progress": 0}
        elif action == "update":
            ok = s["state"] not in (None, "deleted", *TERMINAL) and e.get("generation") == s["generation"]
            if ok:
                s |= {"state": e.get("state") or s["state"], "progress": s["progress"] if e.get("progress") is None else int(e["progress"])}
        elif action == "retry":
            ok = s["state"] in ("error", "cancelled")
            if ok:
                s |= {"state": "queued", "generation": s["generation"] + 1, "progress": 0}
        elif action == "cancel":
            ok = s["state"] not in (None, "deleted", *TERMINAL)
            if ok:
                s["state"] = "cancelled"
        elif action == "delete":
            ok = s["state"] not in (None, "deleted")
            if ok:
                s["state"] = "deleted"
        s["accepted" if ok else "refused"] += 1
    return s


def jobs_after(events: DataFrame) -> DataFrame:
    """State of each job after its events (job_id, seq, action, generation, state, progress)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("seq").astype(object).where(lambda d: d.notna(), None).to_dict("records")
        s = fold_job(rows)
        return pd.DataFrame([(rows[0]["job_id"], s["state"], s["generation"], s["progress"], s["accepted"], s["refused"])], columns=[f.split()[0] for f in JOB_STATE.split(", ")])

    return events.groupBy("job_id").applyInPandas(run, JOB_STATE)


def trials(selections: DataFrame) -> DataFrame:
    """The first song that each guest selects (guest, at, job_id, duration, session_end), with when the trial ends."""
    one = selections.groupBy("guest").agg(F.min_by(F.struct("at", "job_id", "duration", "session_end"), F.struct("at", "job_id")).alias("t")).select("guest", "t.*")
    return one.withColumn("expires_at", trial_expiry(F.col("session_end"), F.col("at"), F.col("duration")))


def select_trial(held: DataFrame, request: dict, now: float) -> tuple[DataFrame, str]:
    """(trials after a guest's selection, what came of it) for a request (guest, job_id, duration, session_end).

    A guest has one selection: asking for the same song again is answered by it ("same"), another song is refused
    ("refused"); after its end, or the session's, all are ("over"). A new selection ("accepted") purges trials whose session has ended.
    """
    own = held.where(F.col("guest") == request["guest"]).limit(1).collect()  # one guest's row
    if own:
        over = own[0]["completed_at"] is not None or own[0]["expires_at"] <= now
        return held, "over" if over else "same" if own[0]["job_id"] == request["job_id"] else "refused"
    if now >= request["session_end"]:
        return held, "over"
    row = held.sparkSession.range(1).select(*(F.lit(request[c]).alias(c) for c in ("guest", "job_id", "duration", "session_end")), F.lit(now).alias("at"), F.lit(None).cast("double").alias("completed_at"))
    row = row.withColumn("expires_at", trial_expiry(F.col("session_end"), F.col("at"), F.col("duration")))
    kept = held.where(F.col("session_end") > now)
    return kept.unionByName(row.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in held.schema.fields))), "accepted"


def trial_state(rows: DataFrame, now: float) -> DataFrame:
    """complete before expired before active before available, with the seconds that are left."""
    state = (
        F.when(F.col("completed_at").isNotNull(), "complete")
        .when(F.col("expires_at") <= now, "expired")
        .when(F.col("job_id").isNotNull(), "active")
        .otherwise("available")
    )
    return rows.withColumn("trial", state).withColumn("remaining", F.greatest(F.lit(0.0), F.coalesce(F.col("expires_at") - now, F.lit(0.0))))


def active_operations(log: DataFrame) -> DataFrame:
    """The first unfinished operation of each job and kind: a second one is answered by it."""
    fields = F.struct(*[c for c in log.columns if c not in ("job_id", "kind")])
    return log.where("state IN ('queued', 'running')").groupBy("job_id", "kind").agg(F.min_by(fields, F.struct("created_at", "id")).alias("_r"), F.count(F.lit(1)).alias("asked")).select("job_id", "kind", "_r.*", "asked")


def worth_replacing(rows: DataFrame, least: int = 5) -> DataFrame:
    """Whether new lyrics replace the old: at least five lines and more than now."""
    return rows.withColumn("replace", (F.col("new_lines") >= least) & (F.col("new_lines") > F.coalesce("line_count", F.lit(0))))


def reusable_stems(jobs: DataFrame, stems: DataFrame) -> DataFrame:
    """Jobs whose separated sound was made from the same source, by the same model, and is unchanged; unknown equals unknown."""
    s = stems.select("job_id", F.col("identity").alias("_i"), F.col("model").alias("_m"), F.col("fingerprint").alias("_f"))
    same = F.col("identity").eqNullSafe(F.col("_i")) & F.col("model").eqNullSafe(F.col("_m")) & F.col("fingerprint").eqNullSafe(F.col("_f"))
    return jobs.join(s, "job_id", "left").withColumn("reusable", same & F.col("_f").isNotNull()).drop("_i", "_m", "_f")
