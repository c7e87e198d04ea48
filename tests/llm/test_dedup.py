from __future__ import annotations

import hashlib
import random

import pytest
from brute import cut_repeats, maximal_repeats, near_groups

from tessitura.llm import common, exact_dedup, minhash, suffix_repeats

SCHEMA = "doc_id long, text string, lang string, digest string, gram long"
rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n, r=rng):
    return " ".join(r.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    """Rows of (doc_id, text) with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows], SCHEMA)


def near_copies():
    rows, i = [], 0
    for _ in range(12):
        base = prose(rng.randint(5, 80)).split()
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((i, " ".join(w)))
            i += 1
    return rows


def test_exact(spark):
    rows = [(3, "a  b"), (1, "a\tb"), (2, "a b "), (5, None), (4, ""), (7, "a b"), (7, "a b"), (None, "a b"), (None, "only null")]
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.exact_dedup(frame(spark, rows)).collect())
    assert got == sorted(
        [("3", "1", 5, False), ("1", "1", 5, True), ("2", "2", 1, True), ("5", "4", 2, False), ("4", "4", 2, True), ("7", "1", 5, False), ("7", "1", 5, False), ("None", "1", 5, False), ("None", "None", 1, True)]
    )


@pytest.mark.parametrize("size", [1, 32])
def test_bytes_decide_where_digests_collide(spark, size):
    rows = [(i, f"text {i % 300}") for i in range(900)]
    got = exact_dedup.exact_dedup(frame(spark, rows), digest_bytes=size).collect()
    assert all(r.keep_id == r.doc_id % 300 and r.group_size == 3 for r in got) and len(got) == 900


def test_state_folds_later_files(spark):
    path, state = common.scratch(spark, "in"), common.scratch(spark, "state")
    schema = "doc_id long, digest binary, sha binary, locator string"
    for ids in ([5, 9], [2]):
        spark.createDataFrame([(i, b"k", b"s", f"f{i}") for i in ids], schema).write.mode("append").parquet(path)
        kept = exact_dedup.digest_state(spark, path, spark.read.parquet(path).schema, state).first()
    assert (kept.keep_id, kept.locator, kept.group_size) == (2, "f2", 3)


def test_near_groups(spark):
    rows = near_copies() + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE  two"), (905, "one"), (906, "é x"), (907, "É x")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_dedup(frame(spark, rows)).collect()}
    assert got == near_groups(rows)


def test_near_groups_with_small_blocks(spark, monkeypatch):
    rows = near_copies()
    monkeypatch.setattr(minhash, "BLOCK", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_dedup(frame(spark, rows)).collect()}
    assert got == near_groups(rows)


def test_near_groups_of_null_and_repeated_ids(spark):
    a, b, c = (prose(40).split() for _ in range(3))
    near = " ".join([*a[:-1], "other"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (None, near), (2, " ".join(b)), (None, " ".join(c)), (None, " ".join(c)), (9, None), (9, None)]
    got = sorted(((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in minhash.near_dedup(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 36, 5, True), (5, 36, 2, False), (None, 36, 5, False), (2, 36, 2, True), (None, 36, None, True), (None, 36, None, True), (9, 0, 9, True), (9, 0, 9, True)], key=str)


def test_long_texts_are_read_whole(spark, monkeypatch):
    from tessitura.llm import words

    rows = near_copies() + [(800, prose(3000)), (801, "y" * 5000 + " " + prose(500))]
    want = near_groups(rows)
    monkeypatch.setattr(words, "BLOCK_BYTES", 64)
    got = {n: list(v) for n, v in ((i, [x for _, h, c in words.word_hashes(words.pa.array([t])) for x in h]) for i, t in rows)}
    monkeypatch.undo()
    for i, t in rows:
        assert got[i] == [x for _, h, c in words.word_hashes(words.pa.array([t])) for x in h] and len(got[i]) == len(t.split())
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 4096)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_dedup(frame(spark, rows)).collect()}
    assert found == want


def test_word_hashes_tell_words_apart():
    from tessitura.llm import words

    def thue(n, a="a", b="b"):
        return "".join((a, b)[bin(k).count("1") % 2] for k in range(n))

    texts = [thue(4096), thue(4096, "b", "a"), thue(64), thue(64, "b", "a"), "ab", "AB", "a b", "abcdefgh", "abcdefgh\x00", "h" * 64, "h" * 65]
    hashes = [tuple(h.tolist()) for _, hs, c in words.word_hashes(words.pa.array(texts)) for h in words.np.split(hs, c.cumsum()[:-1])]
    assert hashes[4] == hashes[5] and len(set(hashes)) == len(texts) - 1 and len(hashes[6]) == 2


def test_rows_are_numbered_once(spark, tmp_path):
    docs = spark.createDataFrame([(k % 7, f"t{k}", "q") for k in range(50)], "doc_id long, text string, _row string")
    docs.repartition(5).write.parquet(f"{tmp_path}/d")
    read = spark.read.parquet(f"{tmp_path}/d")
    for table in (read, read.where("doc_id > 2"), docs, read.join(read.select("doc_id").distinct(), "doc_id"), read.unionByName(read), docs.limit(0)):
        rows, at = common.numbered(table, *table.columns)
        assert at not in table.columns and rows.drop(at).columns == table.columns
        seen = [sorted((r[at], r.text) for r in rows.collect()) for _ in range(2)]
        assert seen[0] == seen[1] and len({n for n, _ in seen[0]}) == len(seen[0]) == table.count()


def test_scratch_folders_go_with_their_step(spark):
    def fails():
        common.written(spark.range(3), "lost")
        raise RuntimeError

    import os

    def folders():
        root = common.scratch_root(spark).removeprefix("file://") + "/tessitura"
        return set(os.listdir(root)) if os.path.exists(root) else set()

    before = folders()
    with pytest.raises(RuntimeError):
        common.settled(fails, "x")
    assert folders() == before
    out = common.settled(lambda: common.written(spark.range(3), "inner").where("id > 0"), "kept")
    assert out.count() == 2 and len(folders() - before) == 1


def test_prune_bounds_grow():
    bounds = minhash.prune_bounds()
    assert bounds == sorted(bounds) and bounds[-1] < minhash.PERMS * 0.75


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in common.components(edges).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}


def passages():
    shared = [prose(rng.randint(20, 60)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [prose(rng.randint(0, 30))] + rng.sample(shared, rng.randint(0, 3)) + [prose(rng.randint(0, 10))]
        rows.append((i, " ".join(parts)))
    line = "z" * 150
    return rows + [(60, line), (61, line), (62, None), (63, ""), (64, "q" * 99), (65, "q" * 99), (66, "é" * 80 + "x"), (67, "ab" * 400), (68, shared[0] * 3)]


@pytest.mark.parametrize(("split", "piece", "broadcast"), [(4096, 1 << 20, 500_000), (3, 150, 500_000), (3, 1 << 20, 0)])
def test_repeats(spark, monkeypatch, split, piece, broadcast):
    rows = passages()
    monkeypatch.setattr(suffix_repeats, "SPLIT", split)
    monkeypatch.setattr(suffix_repeats, "PIECE", piece)
    monkeypatch.setattr(suffix_repeats, "BROADCAST_ROWS", broadcast)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_repeats.remove_repeats(frame(spark, rows)).collect()}
    assert got == cut_repeats(rows)


def test_repeats_of_rows_and_null_ids(spark):
    text = prose(60)
    rows = [(2, text), (2, text), (1, "x" + text), (None, text + "y"), (3, prose(60)), (3, prose(61))]
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in suffix_repeats.remove_repeats(frame(spark, rows)).collect()}
    n = len(text)
    assert got[1, n + 1] == (0, 0) and got[2, n] == (n, 1) and got[None, n + 1] == (n, 1)
    assert [v for k, v in got.items() if k[0] == 3] == [(0, 0), (0, 0)]


@pytest.mark.parametrize(("banded", "piece"), [(20_000, 1 << 20), (1, 300)])
def test_maximal_repeats_with_all_occurrences(spark, monkeypatch, banded, piece):
    r = random.Random(11)
    a, b, c = (prose(60, r) for _ in range(3))
    rows = [(k, r.choice("xyz") + t + r.choice("uvw")) for k, t in enumerate([a, a, a + b, b + a, a[:150], "q" + a[20:180], a[30:200] + b[:140], c, c, c, b, prose(80, r)])]
    rows += [(50, None), (51, ""), (52, "ab" * 120), (53, rows[0][1]), (54, rows[0][1])]
    monkeypatch.setattr(suffix_repeats, "BANDED", banded)
    monkeypatch.setattr(suffix_repeats, "PIECE", piece)
    got = suffix_repeats.repeat_groups(frame(spark, rows)).collect()
    want = {(hashlib.blake2b(w, digest_size=16).hexdigest(), len(w), d, i) for w, d, i in maximal_repeats(rows)}
    assert len(want) > 100 and not any(x.clipped for x in got)
    assert sorted((x.repeat, x.n_bytes, x.doc_id, x.start) for x in got) == sorted(want)
    clipped = suffix_repeats.repeat_groups(frame(spark, rows), reach=120).collect()
    assert any(x.clipped for x in clipped)


def test_one_anchor_of_a_long_text_is_that_of_its_pieces(spark, monkeypatch):
    text = prose(4000)
    whole = suffix_repeats.remove_repeats(frame(spark, [(1, text), (2, text[5000:9000] + "!")])).collect()
    monkeypatch.setattr(suffix_repeats, "PIECE", 777)
    assert sorted(suffix_repeats.remove_repeats(frame(spark, [(1, text), (2, text[5000:9000] + "!")])).collect()) == sorted(whole)


def test_intervals_and_losers():
    # suffixes with common prefixes 3, 1, 2
    assert sorted(suffix_repeats.intervals([3, 1, 2])) == [(1, 0, 3), (2, 2, 3), (3, 0, 1)]
    assert sorted(suffix_repeats.losers([2, 0, 1], [5, 3])) == [(1, 3), (2, 5)]


@pytest.mark.parametrize("run", [exact_dedup.exact_dedup, minhash.near_dedup, suffix_repeats.remove_repeats])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_true_link_is_hardly_ever_pruned():
    # chance that a pair at the threshold falls below a bound at any look
    t, alive, lost, last = minhash.NEED / 100, {0: 1.0}, 0.0, 0
    for k, least in enumerate(minhash.prune_bounds(), 1):
        for _ in range(last, k * minhash.BATCH):
            step: dict = {}
            for m, p in alive.items():
                step[m + 1] = step.get(m + 1, 0.0) + p * t
                step[m] = step.get(m, 0.0) + p * (1 - t)
            alive = step
        last = k * minhash.BATCH
        lost += sum(p for m, p in alive.items() if m < least)
        alive = {m: p for m, p in alive.items() if m >= least}
    bands = (1 - t**minhash.ROWS) ** (minhash.PERMS // minhash.ROWS)
    assert lost < 5e-6 and lost + bands < 1.1e-5, (lost, bands)
