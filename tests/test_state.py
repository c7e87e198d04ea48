from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from tessitura.operators import history, jobs, rooms, settings, signal
from tessitura.streaming import evidence

T = 1_000_000


def told(reports):
    state, out = None, []
    for r in reports:
        state, yes = evidence.observe(state, r)
        out.append(yes)
    return out


def test_evidence_needs_media_and_clock():
    assert told([(1, T, 0, "playing"), (1, T + 2500, 2500, "playing"), (1, T + 5000, 5000, "playing")]) == [False, False, True]
    assert told([(1, T, 0, "playing"), (1, T + 5000, 0, "playing"), (1, T + 9000, 0, "playing")]) == [False] * 3
    assert told([(1, T, 0, "playing"), (1, T + 5000, 60_000, "playing"), (1, T + 9000, 64_000, "playing")]) == [False, False, True]


def test_evidence_windows_break():
    assert told([(1, T, 0, "playing"), (1, T + 2000, 2000, "paused"), (1, T + 4000, 4000, "playing"), (1, T + 6000, 6000, "playing")]) == [False] * 4
    assert told([(1, T, 9000, "playing"), (1, T + 4000, 2000, "playing"), (1, T + 8000, 6000, "playing")]) == [False, False, True]
    assert told([(1, T, 0, "playing"), (2, T + 4000, 4000, "playing"), (2, T + 8000, 8000, "playing")]) == [False, False, True]


def test_evidence_is_told_every_ten_seconds():
    reports = [(1, T + k * 2500, k * 2500, "playing") for k in range(11)]
    assert [k for k, yes in enumerate(told(reports)) if yes] == [2, 6, 10]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, "ab"[k % 2], 1, T + k * 1500, (k // 2) * 3000, "playing" if k % 11 else "paused") for k in range(60)]
    schema = "id long, key string, generation int, at_ms long, position_ms long, status string"
    df = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, evidence.confirmed(df).collect()))
    df.orderBy("id").coalesce(1).write.parquet(str(tmp_path / "in"))
    evidence.use_rocksdb(spark)
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = evidence.confirmed_stream(stream).writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("told").collect())) == want and want


def test_ranking_golden(spark):
    rows, n = [], 0
    for song, plays, last in (("a", 80, 500.0), ("b", 30, 900.0), ("c", 1, 10.0), ("d", 1, 10.0), ("", 5, 1.0)):
        for k in range(plays):
            n += 1
            rows.append((n, "me", song, last - k))
    got = history.ranking(spark.createDataFrame(rows, "id long, account_id string, job_id string, started_at double")).orderBy("place").collect()
    assert [(r.job_id, r.plays) for r in got] == [("a", 80), ("b", 30), ("c", 1), ("d", 1)]
    assert sum(r.plays for r in got) == 112


def test_retention_is_cut_before_the_shuffle(spark):
    df = spark.range(2000).selectExpr("id", "id % 3 AS account_id")
    kept = history.retain(df, 50)
    assert kept.count() == 150
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_accounts_stay_apart(spark):
    rows = spark.createDataFrame([(1, "a", "k"), (2, "b", "k")], "id long, account_id string, play_key string")
    gone = spark.createDataFrame([("b", 1)], "account_id string, id long")
    assert history.delete_entries(rows, gone).count() == 2


def test_room_commands():
    room = rooms.Room()
    add = {"command_id": "1", "action": "add", "job_id": "s1", "member_id": "m"}
    assert room.apply(add) == "accepted" and room.playing and room.current["job_id"] == "s1"
    assert room.apply(add) == "repeated"
    assert room.apply(add | {"job_id": "s2"}) == "refused"
    assert room.apply({"command_id": "2", "action": "add", "job_id": "s2", "expected_revision": 9}) == "refused"
    for k, song in enumerate(("s2", "s3")):
        room.apply({"command_id": f"a{k}", "action": "add", "job_id": song})
    assert room.apply({"command_id": "3", "action": "top", "item_id": "i3"}) == "accepted"
    assert [i["job_id"] for i in room.queue] == ["s3", "s2"]
    assert room.apply({"command_id": "4", "action": "next", "item_id": "i9"}) == "refused"
    assert room.apply({"command_id": "5", "action": "next", "item_id": "i1"}) == "accepted" and room.current["job_id"] == "s3"
    assert room.apply({"command_id": "6", "action": "seek", "item_id": "i3", "position": -1.0}) == "refused"
    assert room.apply({"command_id": "7", "action": "fly"}) == "refused"


def test_job_fold():
    s = jobs.fold_job([{"action": "create"}, {"action": "update", "generation": 1, "state": "running", "progress": 40}, {"action": "cancel"}, {"action": "update", "generation": 1}, {"action": "retry"}, {"action": "update", "generation": 1}])
    assert (s["state"], s["generation"], s["accepted"], s["refused"]) == ("queued", 2, 4, 2)


def test_account_fold():
    s = settings.fold_account([{"action": "defaults", "payload": json.dumps({"reverb": "hall", "nope": 1})}, {"action": "prefer", "device_id": "d", "expected": 0}, {"action": "prefer", "device_id": "d", "expected": 1}, {"action": "remove_device", "device_id": "d"}])
    assert s["defaults"] == {"reverb": "hall"} and s["preferred_player"] is None and (s["revision"], s["refused"]) == (3, 1)


def test_offset_of_a_synthetic_voice():
    rate, lines = 16000, [(10.0 + 4 * k, 12.0 + 4 * k) for k in range(14)]
    rng = np.random.default_rng(1)
    sound = rng.normal(0, 0.02, rate * 76).astype(np.float32)
    for a, b in lines:
        sound[int(a * rate) : int(b * rate)] += rng.normal(0, 0.25, int((b - a) * rate)).astype(np.float32)
    for shift in (-9.0, -5.8, -2.0, 3.5, 11.0):
        found, certainty = signal.best_offset(sound, [(a + shift, b + shift) for a, b in lines], rate)
        assert abs(found + shift) <= 0.5 and certainty > 1
    assert abs(signal.best_offset(sound, lines, rate)[0]) <= 0.2
    assert signal.best_offset(sound, [], rate) == (0.0, 0.0)


def test_claims_count_attempts(spark):
    kind = "task_id long, kind string, state string, worker_id string, claim_token string, attempts int, lease_expires double, created_at double"
    tasks = spark.createDataFrame([(1, "a", "waiting", None, None, 0, 0.0, 5.0), (2, "a", "running", "w", "t", 1, 9.0, 1.0), (3, "b", "waiting", None, None, 0, 0.0, 0.0)], kind)
    one = {r.task_id: (r.state, r.worker_id, r.claim_token, r.attempts) for r in rooms.claimed(tasks, "v", ["a"], 10.0, "u", 60.0).collect()}
    assert one == {1: ("waiting", None, None, 0), 2: ("running", "v", "u", 2), 3: ("waiting", None, None, 0)}
    late = {r.task_id: (r.state, r.worker_id, r.attempts) for r in rooms.requeued(tasks, 10.0).collect()}
    assert late[2] == ("waiting", None, 1)
    held = rooms.claimed(tasks, "v", ["c"], 1.0, "u", 60.0).where("state = 'running'").collect()
    assert [(r.task_id, r.worker_id) for r in held] == [(2, "w")]


def test_attempts_after_eight_failures(spark):
    rows = [("r", 1000 * k, k, True) for k in range(8)] + [("r", 7000, 8, False), ("r", 59_999, 9, False), ("r", 60_000, 10, False), ("r", 67_000, 11, True), ("q", 0, 0, True)]
    got = {r.seq: (r.recent, r.refused) for r in rooms.failures_in_window(spark.createDataFrame(rows, "key string, at long, seq int, failed boolean")).where("key = 'r'").collect()}
    assert got[0] == (0, False) and got[7] == (7, False) and got[8] == (8, True) and got[9] == (8, True)
    assert got[10] == (7, False) and got[11] == (0, False)


def test_whistle_and_voice(spark):
    def spectrum(peaks, floor=-90.0, n=512):
        s = [floor] * n
        for at, db in peaks:
            s[at] = db
        return s

    cases = {
        "whistle": spectrum([(100, -20.0)]),
        "voice": spectrum([(30, -25.0), (60, -28.0), (91, -30.0)]),
        "second only": spectrum([(30, -25.0), (60, -28.0)]),
        "beyond the band": spectrum([(250, -22.0), (500, -26.0)]),
        "quiet": spectrum([(100, -80.0)], -120.0),
        "flat": [-60.0] * 512,
        "silent": [float("-inf")] * 512,
        "short": [-60.0] * 8,
        "below the band": spectrum([(5, -10.0)]),
    }
    rows = spark.createDataFrame(list(cases.items()), "name string, s array<double>")
    got = {r.name: r.p for r in rows.select("name", signal.peak(F.col("s"), 20.0).alias("p")).collect()}
    assert {n for n, p in got.items() if p is not None} == {"whistle", "second only", "beyond the band"}
    assert (got["whistle"].bin, got["whistle"].hz, got["whistle"].db, got["whistle"].prominence) == (100, 2000.0, -20.0, 70.0)


def told_frames(frames, need=6, near=2):
    """The rule by hand: frames are (bin, db) or None."""
    begin, hits, last, out = None, 0, None, []
    for k, peak in enumerate(frames):
        if peak is None:
            begin, hits, last = None, 0, None
            continue
        hits = hits + 1 if begin is not None and abs(peak[0] - begin) <= near else 1
        begin = peak[0] if hits == 1 and not (begin is not None and abs(peak[0] - begin) <= near) else begin
        rising = last is None or peak[1] > last - 1
        last = peak[1]
        if hits >= need and rising:
            out.append(k)
            hits = 0
    return out


def test_confirmed_runs_equal_the_rule(spark):
    import random

    r = random.Random(3)
    tracks = {0: [(50, -20.0)] * 14, 1: [(50, -20.0 - k) for k in range(8)] + [(51, -27.5)], 2: [(50, -20.0)] * 5 + [None] + [(50, -20.0)] * 6, 3: [(50 + k, -20.0) for k in range(12)]}
    for k in range(4, 30):
        at, frames = 100, []
        for _ in range(80):
            at = at + r.choice([-3, -1, 0, 0, 0, 0, 1, 2]) if r.random() < 0.9 else r.randint(0, 200)
            frames.append(None if r.random() < 0.05 else (at, -20 + r.choice([0.0, 0.4, -0.9, -1.5])))
        tracks[k] = frames
    rows = [(key, n, *(f or (None, None))) for key, frames in tracks.items() for n, f in enumerate(frames)]
    got = {}
    for x in signal.confirmed_runs(spark.createDataFrame(rows, "key int, frame int, bin int, db double"), "key", "frame").collect():
        got.setdefault(x.key, []).append(x.frame)
    assert {k: sorted(v) for k, v in got.items()} == {k: told_frames(f) for k, f in tracks.items() if told_frames(f)}


def test_one_selection_of_a_guest(spark):
    held = spark.createDataFrame([("old", "s", 100.0, 50.0, 10.0, None, 60.0), ("g", "s1", 100.0, 900.0, 10.0, None, 500.0)], "guest string, job_id string, duration double, session_end double, at double, completed_at double, expires_at double")
    ask = lambda guest, job, now=200.0, end=900.0: jobs.select_trial(held, {"guest": guest, "job_id": job, "duration": 100.0, "session_end": end}, now)
    assert ask("g", "s1")[1] == "same" and ask("g", "s2")[1] == "refused" and ask("g", "s1", 600.0)[1] == "over" and ask("n", "s", 950.0)[1] == "over"
    after, said = ask("n", "s9")
    assert said == "accepted" and {(r.guest, r.expires_at) for r in after.collect()} == {("g", 500.0), ("n", 600.0)}
