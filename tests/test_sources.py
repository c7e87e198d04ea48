from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tessitura.functions import clock, text
from tessitura.operators import browse, history, imports, match, settings
from tessitura.sources import catalog, media, publish


def write(folder, name, body):
    (folder / name).mkdir(parents=True)
    (folder / name / "status.json").write_text(body, encoding="utf-8")


def test_catalog_scan(spark, tmp_path):
    good = {"id": "0123456789ab", "title": "t", "state": "running", "duration": 10.0, "created_at": 1.0}
    write(tmp_path, "0123456789ab", json.dumps(good, indent=1))
    write(tmp_path, "aaaaaaaaaaaa", json.dumps(good | {"id": "bbbbbbbbbbbb"}))
    write(tmp_path, "cccccccccccc", "{not json")
    write(tmp_path, "short", json.dumps(good | {"id": "short"}))
    rows = catalog.jobs(spark, str(tmp_path)).collect()
    assert [(r.id, r.state, r.generation) for r in rows] == [("0123456789ab", "queued", "")]


def test_room_snapshot(spark, tmp_path):
    playback = {"playing": True, "guide": True, "position": 7.5, "seek_version": 4}
    room = {"id": "r", "created_at": 100.0, "updated_at": 100.0, "revision": 3, "queue": [{"id": "i1", "job_id": "s"}], "host": "h", "pair": "p", "controllers": [], "current": None, "playback": playback, "commands": [["c1", "x"]]}
    without = [{k: v for k, v in room.items() if k != gone} for gone in ("host", "current", "commands")]
    (tmp_path / "rooms.json").write_text(json.dumps({"schema": 1, "rooms": [room, room | {"id": "old", "updated_at": -99999.0}, {"id": "bad"}, "no room", *without]}))
    restored = catalog.rooms(spark, str(tmp_path / "rooms.json"), 200.0)
    (r,) = restored.collect()
    assert (r.id, r.revision, r.playback.playing, r.playback.guide, r.playback.position, r.playback.seek_version) == ("r", 4, False, True, 7.5, 5)
    assert catalog.write_rooms(restored, f"{tmp_path}/kept") == 1
    (again,) = catalog.rooms(spark, f"{tmp_path}/kept", 200.0).collect()
    assert (again.revision, again.playback.seek_version, again.commands, again.queue[0].job_id) == (5, 6, [["c1", "x"]], "s")


def test_of_two_writers_one_publishes(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    log = lambda *ids: spark.createDataFrame([(i, "j", "k", "running", 1.0, 1.0, "t", "") for i in ids], "id string, job_id string, kind string, state string, created_at double, updated_at double, token string, error string")
    assert catalog.write_operations(log("a"), path) == 1

    def write(k):
        try:
            return publish.publish(log(f"w{k}"), path, generation=1, expected=1)
        except publish.StaleWriter:
            return None

    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(write, range(4)))
    assert sorted(done, key=str) == [2, None, None, None]
    assert [r.id for r in catalog.operations(spark, path).collect()] == [f"w{done.index(2)}"]
    with pytest.raises(publish.StaleWriter):
        catalog.write_operations(log("late"), path, generation=0)
    old = catalog.operations(spark, path)
    assert catalog.write_operations(old.unionByName(log("b")), path, generation=1) == 3  # from the path itself
    assert catalog.operations(spark, path).count() == 2 and [r.id for r in old.collect()] == [f"w{done.index(2)}"]
    assert publish.prune(spark, path, keep=1) == 2 and catalog.operations(spark, path).count() == 2


def test_scan_prunes_stops_and_probes_once(spark, tmp_path):
    for name in ("b/x [abcdefghijk].mp4", "b/c/y.flac", "a.mp3", "_hidden/z.mp4", "b/.secret/q.mp3", "b/note.txt", "c_[abcdefghij!].mp3", "b/c/d/deep.mkv"):
        (tmp_path / "m" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "m" / name).write_bytes(b"12345")
    for hidden in ("_hidden", "b/.secret"):
        (tmp_path / "m" / hidden).chmod(0)  # a listing would fail for all but root
    rows, more = media.scan(spark, [str(tmp_path / "m")])
    assert [(r.rel_path, r.title, r.video_id) for r in rows.collect()] == [
        ("a.mp3", "a", None), ("b/c/d/deep.mkv", "deep", None), ("b/c/y.flac", "y", None), ("b/x [abcdefghijk].mp4", "x", "abcdefghijk"), ("c_[abcdefghij!].mp3", "c_[abcdefghij!]", None),
    ] and not more
    few, more = media.scan(spark, [str(tmp_path / "m")], limit=2)
    assert [r.rel_path for r in few.collect()] == ["a.mp3", "b/c/d/deep.mkv"] and more
    listed = []
    reader = media._Reader({"path": str(tmp_path / "m"), "limit": "1"})
    real, media.os.scandir = media.os.scandir, lambda p: listed.append(str(p)) or real(p)
    try:
        assert [len(list(reader.read(p))) for p in reader.partitions()] == [1, 1, 1]
    finally:
        media.os.scandir = real
    assert not any("hidden" in p or "secret" in p for p in listed)

    tries = tmp_path / "tries"
    tries.mkdir()

    def probe(path):
        (tries / path.replace("/", "+")).open("a").write("x")
        return None if path.endswith(".mp3") else 12.5

    none = spark.createDataFrame([], "path string, size long, mtime long, duration double")
    every, known = media.probed(rows, none, probe)
    known.write.parquet(f"{tmp_path}/known")
    again, _ = media.probed(rows, spark.read.parquet(f"{tmp_path}/known"), probe)
    before = {p.name: p.stat().st_size for p in tries.iterdir()}
    assert sorted((r.rel_path, r.duration) for r in again.collect() if r.duration) == [("b/c/d/deep.mkv", 12.5), ("b/c/y.flac", 12.5), ("b/x [abcdefghijk].mp4", 12.5)]
    grown = {n for n, size in before.items() if (tries / n).stat().st_size > size}
    assert grown and all(n.endswith(".mp3") for n in grown)


def test_media_scan(spark, tmp_path):
    for name in ("a [abcdefghijk].mp4", "sub/b.flac", "_dup/c.mp4", "sub/.x/d.mp3", "note.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    rows = {r.rel_path: (r.size, r.video_id) for r in catalog.media_files(spark, str(tmp_path)).collect()}
    assert rows == {"a [abcdefghijk].mp4": (5, "abcdefghijk"), "sub/b.flac": (5, None)}
    media = spark.createDataFrame([("/m/a.mp4",)], "path string")
    subs = spark.createDataFrame([("/m/a.zh.srt",), ("/m/a.vtt",), ("/m/ab.srt",)], "path string")
    assert {(r.subtitle, r.language) for r in catalog.sidecars(media, subs).collect()} == {("/m/a.zh.srt", "zh"), ("/m/a.vtt", None)}


def test_tag_changes_with_any_row_and_place(spark, monkeypatch):
    monkeypatch.setattr(catalog, "FAN", 3)
    rows = [(k, f"t{k}", None if k % 3 else "x") for k in range(20)]
    tag = lambda r, parts=2, order=("id",): catalog.etag(spark.createDataFrame(r, "id long, title string, note string").repartition(parts), list(order)).first()[0]
    whole = tag(rows)
    assert whole == tag(rows[::-1], 5) and whole.startswith('W/"') and len(whole) == 68
    assert len({whole, tag(rows[:-1]), tag(rows[:7] + [(7, "t7", "x")] + rows[8:]), tag([(k, f"t{(k + 1) % 20}", n) for k, _, n in rows]), tag(rows, order=("title",)), tag(rows[:1]), tag([])}) == 7


def test_names_and_times(spark):
    row = spark.range(1).select(
        text.origin(F.lit("HTTPS://Example.org:443/")).alias("o"), text.origin(F.lit("ftp://x")).alias("bad"), text.glob_escape(F.lit("a[1]*")).alias("g"),
        text.video_id(F.lit("https://youtu.be/abcdefghijk?t=3")).alias("v"), text.label(F.lit(" x ")).alias("l"), text.label(F.lit("a\tb")).alias("lb"), text.hidden_path(F.lit("a/.b/c")).alias("h"),
        clock.subtitle_seconds(F.lit("1:02:03,5")).alias("s"), clock.subtitle_seconds(F.lit("7")).alias("sb"), clock.lrc_stamp(F.lit(59.999)).alias("st"), clock.editor_seconds(F.lit("2:03.5")).alias("e"),
        text.friendly_error(F.lit("Video unavailable")).alias("f"), text.is_transient(F.lit("Segmentation fault")).alias("tr"), text.is_transient(F.lit("HTTP 503")).alias("nt"), text.suggestion(F.lit("石橋 《 夜 》【MV】")).alias("sg"), text.canonical_name(F.lit(" A "), F.lit("b/c"), F.lit("id"), F.lit(".mp4")).alias("cn"), text.canonical_name(F.lit("A"), F.lit(" "), F.lit("id")).alias("cx"), text.safe_name(F.lit(" .. ")).alias("sn"), text.dedupe_key(F.lit(" 稻香 (Live) ")).alias("k"), text.artist_key(F.lit("ＢＥＹＯＮＣÉ  A/B")).alias("ak"),
    ).first()
    assert (row.o, row.bad, row.g, row.v, row.l, row.lb, row.h) == ("https://example.org", None, "a[[]1[]][*]", "abcdefghijk", "x", None, True)
    assert (row.nt, row.sg, row.cn, row.cx, row.sn) == (False, "石橋 《 夜 》", "A - b c [id].mp4", None, "")
    assert (row.s, row.sb, row.st, row.e, row.f, row.tr, row.k, row.ak) == (3723.5, None, "[00:60.00]", 123.5, "unavailable", True, "稻香live", "beyoncé a/b")


def test_states_and_reuse(spark):
    job = "id long, video_id string, local_path string, state string, created_at double"
    rows = spark.createDataFrame([(1, "v", "", "pending", 1.0), (2, "v", "", "separating", 2.0), (3, "", "p", "done", 1.0), (4, "w", "q", "error", 1.0), (5, "x", "", "running", 1.0)], job)
    ask = spark.createDataFrame([(1, "v", ""), (2, "", ""), (3, "", "p"), (4, "w", "q"), (5, None, None)], "request_id long, video_id string, path string")
    fresh, reused = imports.create_or_reuse(ask, rows)
    assert {r.request_id: r.job_id for r in reused.collect()} == {1: 1, 3: 3} and {r.request_id for r in fresh.collect()} == {2, 4, 5}
    entries = spark.createDataFrame([(v, 10.0, False) for v in ("v", "w", "x", "", "n")], "video_id string, duration double, unavailable boolean")
    assert {r.video_id: r.status for r in imports.listing_status(entries, rows).collect()} == {"v": "failed", "w": "failed", "x": "pending", "": "new", "n": "new"}


def test_requests_meet_only_the_newest_job_of_a_key(spark):
    jobs = spark.range(300).selectExpr("id", "if(id % 3 = 0, 'v', '') AS video_id", "if(id % 3 = 1, 'p', '') AS local_path", "'done' AS state", "double(id % 7) AS created_at")
    ask = spark.range(200).selectExpr("id AS request_id", "'v' AS video_id", "if(id % 2 = 0, 'p', 'q') AS path")
    fresh, reused = imports.create_or_reuse(ask, jobs)
    video, path = (max((k % 7, k) for k in range(300) if k % 3 == r) for r in (0, 1))
    assert fresh.count() == 0 and {r.request_id: r.job_id for r in reused.collect()} == {k: max(video, path)[1] if k % 2 == 0 else video[1] for k in range(200)}
    # jobs are folded by key before they meet requests, twice, and the answers once more
    assert reused._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 3


def test_paging(spark):
    rows = spark.range(544).withColumnRenamed("id", "n")
    first = browse.offset_page(rows, ["n"], -3).collect()
    last = browse.offset_page(rows, ["n"], 99).collect()
    assert (len(first), first[0].page, first[0].pages) == (24, 1, 23) and (len(last), last[0].page) == (16, 23)


def test_union_first_wins(spark):
    a, b = (spark.createDataFrame(rows, "id int, v string") for rows in ([(1, "a")], [(1, "b"), (2, "b")]))
    assert {(r.id, r.v) for r in match.union_first([a, b], "id").collect()} == {(1, "a"), (2, "b")}


def test_profiles_trials_and_replies(spark):
    devices = spark.createDataFrame([("a", "d", "tv", '["screen", "pilot"]'), ("b", "d", "x", None)], "account_id string, device_id string, label string, roles string")
    assert [(r.label, r.roles) for r in settings.device_profile(devices, "a", "d").collect()] == [("tv", ["screen"])]
    assert settings.device_profile(devices, "a", "e").count() == 0 and settings.device_profile(devices, "b", "d").first().roles == []
    assert catalog.trials(spark).count() == 0
    replies = spark.createDataFrame([("a", "a", ["s"], 3, 5), ("a", "b", ["s"], 3, 5), ("a", "a", ["s"], -1, 5), ("a", "a", ["s", "t"], 3, 1), ("a", "a", None, 3, 5)], "account_id string, asked_by string, songs array<string>, total_plays int, history_limit int")
    assert [r.wrong for r in history.valid_statistics(replies).collect()] == [None, "account changed", "invalid", "invalid", "invalid"]


def test_operation_log_is_written_and_read(spark, tmp_path):
    log = spark.createDataFrame([("o", "j", "align", "running", 1.0, 2.0, "t", None)], "id string, job_id string, kind string, state string, created_at double, updated_at double, token string, error string")
    catalog.write_operations(log, str(tmp_path / "ops"))
    back = catalog.operations(spark, str(tmp_path / "ops")).collect()
    assert [(r.id, r.state) for r in back] == [("o", "queued")] and "token" not in catalog.public_operations(catalog.operations(spark, str(tmp_path / "ops"))).columns
