"""Vector codes, nearest neighbours and the divergence of sources against plain versions, with odd and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.llm import divergence, neighbours, vector_codes

INF, NAN = float("inf"), float("nan")
KIND = "vec_id long, embedding array<double>, label int"
CLASH = ("code", "error", "shard", "leaf", "turn", "score", "rank", "of", "n", "docs", "term", "p", "base", "total")


def clash(df):
    """df with columns of names that the operators use themselves."""
    return df.withColumns({name: F.lit(0) for name in CLASH})


def plain_codes(rows, parts, entries, rounds):
    """(vec_id, code, error, label_error) of clean rows, and the digest of the codebooks, with Python's whole numbers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[math.floor(256 * v) if abs(v) < 1e300 else 256 * int(v) for v in e] for _, e, _ in rows]
    width = len(x[0]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in x[:entries]] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            sums = defaultdict(list)
            for v in x:
                sums[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(sums[k]) for c in zip(*sums[k], strict=True)] if k in sums else e for k, e in enumerate(books[p])]
    found = [[near(cut(v, p), books[p]) for p in range(parts)] for v in x]
    errors = [min(sum(d for d, _ in f), vector_codes.LARGEST) for f in found]
    labels = Counter()
    for (_, _, label), e in zip(rows, errors, strict=True):
        labels[label] += e
    out = [(i, "".join(f"{k:02x}" for _, k in f), e, min(labels[label], vector_codes.LARGEST)) for (i, _, label), f, e in zip(rows, found, errors, strict=True)]
    return sorted(out, key=str), hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def some_vectors(n, size, seed, scale=1.0):
    r = random.Random(seed)
    centres = [[r.gauss(0, scale) for _ in range(size)] for _ in range(5)]
    return [(i, [c + r.choice((0.0, 0.01, r.gauss(0, scale / 4))) for c in r.choice(centres)], r.choice((0, 1, None))) for i in range(n)]


@pytest.mark.parametrize("scale, rounds", [(1.0, 2), (0.02, 4), (3e7, 2), (1e160, 1)])
def test_codes_equal_plain_lloyd(spark, scale, rounds):
    rows = some_vectors(150, 8, 3, scale) + [(7, [0.5 * scale] * 8, 1), (None, [0.25 * scale] * 8, None)]
    bad = [(900, None, 1), (901, [], 1), (902, [NAN] * 8, 1), (903, [0.0] * 7 + [INF], 1), (904, [1.0] * 7 + [None], 1), (905, [1.0] * 4, 1), (906, [1.0] * 9, 1)]
    table = clash(spark.createDataFrame(rows + bad, KIND)).repartition(3)
    got = vector_codes.compress(table, parts=4, entries=16, rounds=rounds).collect()
    want, digest = plain_codes(rows, 4, 16, rounds)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_few_equal_and_no_vectors(spark):
    few = [(3, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [1.0, 2.0], None)]
    got = vector_codes.compress(spark.createDataFrame(few, KIND), parts=2).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == [(1, "0000", 0, 0), (2, "0000", 0, 0), (3, "0000", 0, 0)]
    assert vector_codes.compress(spark.createDataFrame([(1, None, 0)], KIND)).collect() == []
    assert vector_codes.compress(spark.createDataFrame([], KIND)).collect() == []


def test_bounds_hold_and_save_work():
    r = np.random.default_rng(5)
    x = vector_codes.whole(r.normal(size=(2000, 4)))
    book = vector_codes.Codebook(x[:64])
    code, best, upper, lower = book.assign(x, None, None, None)
    moved, shifts = vector_codes._moved([book], {(0, k): (int((code == k).sum()), [int(v) for v in x[code == k].sum(axis=0)]) for k in range(64)})
    up, low = upper + shifts[0][code], np.maximum(lower - shifts[0][None, :], 0)
    exact = np.sqrt(vector_codes.squared(x[:, None, :], moved[0].entries[None, :, :]))
    assert (up >= exact[np.arange(2000), code]).all() and (low <= exact).all()
    seen = []
    squared = vector_codes.squared
    vector_codes.squared = lambda a, b: seen.append(np.broadcast_shapes(a.shape, b.shape)) or squared(a, b)
    try:
        new, far, _, _ = moved[0].assign(x, code.copy(), up, low.copy())
    finally:
        vector_codes.squared = squared
    assert (new == exact.argmin(axis=1)).all() and (far == (exact**2).round().min(axis=1)).all()
    assert sum(s[0] for s in seen) < 0.25 * exact.size


def plain_nearest(rows, every, k):
    vectors = defaultdict(set)
    for i, e, _ in rows:
        vectors[i].add(tuple(e))

    def far(a, b):
        total = 0.0
        for p, q in zip(a, b, strict=True):
            total += (p - q) * (p - q)
        return math.sqrt(total)

    out = []
    for q in vectors:
        if q % every == 0:
            near = sorted((min(far(a, b) for a in vectors[q] for b in vectors[i]), i) for i in vectors if i != q)[:k]
            out += [(q, n, i, s) for n, (s, i) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_factor_one_is_exact(spark, seed):
    rows = some_vectors(600, 6, seed) + [(20, [0.1] * 6, 0), (20, [0.1] * 6, 0), (21, [0.1] * 6, 0), (40, [9.0] * 6, 1)]
    rows += [(1000 + i, [0.1] * 6, 0) for i in range(300)]  # a third of all rows are one vector
    bad = [(2000, None, 1), (2010, [0.0] * 6, 1), (2020, [NAN] * 6, 1), (2030, [1.0] * 5 + [None], 1), (None, [1.0] * 6, 1), (2040, [1.0] * 5, 1)]
    table = clash(spark.createDataFrame(rows + bad, KIND)).repartition(4)
    got = neighbours.nearest(table, every=10, k=4, shard_rows=64, leaf_rows=8).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == plain_nearest(rows, 10, 4)


def test_relaxed_pruning_reads_less_and_finds_most(spark):
    rows = some_vectors(1500, 3, 9)
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    shard = neighbours.Shard.build(ids, x, 16)
    read = []
    for factor in (1.0, 1.5):
        asked = []
        found, real = 0, neighbours.distances
        neighbours.distances = lambda a, b, real=real, asked=asked: asked.append(max(a.shape[0], b.shape[0])) or real(a, b)
        try:
            _, near, _ = shard.search(x[:50], ids[:50], np.full(50, np.inf), 10, factor)
        finally:
            neighbours.distances = real
        for q in range(50):
            exact = np.lexsort((ids, real(x[q][None, :], x)))
            found += len(set(near[q]) & set(ids[exact][ids[exact] != q][:10]))
        read.append((found / 500, sum(asked)))
    assert read[0][0] == 1.0 and read[1][0] >= 0.9 and read[1][1] <= read[0][1]


def test_few_and_no_candidates(spark):
    got = neighbours.nearest(spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0)], KIND), every=2).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1)] and got[0].score == math.sqrt(2)
    assert neighbours.nearest(spark.createDataFrame([(0, [1.0, 0.0], 0)], KIND)).collect() == []
    assert neighbours.nearest(spark.createDataFrame([(0, None, 0)], KIND)).collect() == []
    assert neighbours.nearest(spark.createDataFrame([], KIND)).collect() == []
    with pytest.raises(ValueError):
        neighbours.nearest(spark.createDataFrame([], KIND), factor=0.5)


def plain_divergence(rows, least, top):
    docs = defaultdict(lambda: defaultdict(set))
    groups = defaultdict(Counter)
    for n, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        groups[lang, source].update(found)
        for t in found:
            docs[lang][t].add(n)
    out = []
    for (lang, source), own in groups.items():
        kept = [t for t, d in docs[lang].items() if len(d) >= least]
        v = len(kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * v) for t in kept}  # noqa: B023, E731
        p = share(own)
        q = share(sum((c for (x, _), c in groups.items() if x == lang), Counter()))
        pairs = [(sum(abs(p[t] - b) for t, b in share(c).items()), s) for (x, s), c in groups.items() if x == lang and s != source]
        terms = [(p[t] - q[t], t) for t in kept if own[t] > 0 and p[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(items, key=lambda i: (-i[0], i[1].encode()))[:most]
            out += [(lang, source, part, item, value, n) for n, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("top", [3, 50])
def test_divergence_equals_plain(spark, top, monkeypatch):
    r = random.Random(4)
    words = [w + e for w in ("alpha", "Beta", "été", "zoë", "gamma-ray", "東京", "x" * 40 + "a", "x" * 40 + "b", "q", "qq", "qqq", "qqqq") for e in ("", "s", "é")]
    rows = [(" ".join(r.choice(words[: r.randint(3, len(words))]) for _ in range(r.randint(0, 30))), r.choice(["en", "fr", None]), r.choice(["a", "a", "a", "b", "ç", None])) for _ in range(150)]
    rows += [(" ".join(words), "en", "d"), (None, "en", "empty"), ("", "xx", "alone"), ("12 34", "xx", "other"), (" ".join(words) * 300, "fr", "a"), *[("same words here", "en", "c")] * 40]
    monkeypatch.setattr(divergence, "PIECE", 64)
    monkeypatch.setattr(divergence, "KEEP_ENTRIES", 20)
    table = clash(spark.createDataFrame(rows, "text string, lang string, source string")).repartition(3)
    got = divergence.source_divergence(table, least_docs=5, top=top).collect()
    assert sorted(tuple(x) for x in got) == plain_divergence(rows, 5, top)


def test_ties_go_by_bytes(spark):
    words = ["a", "aa", "aab", "ab", "b", "ba", "é", "éa", "z" * 30, "z" * 30 + "a"]
    rows = [(" ".join(words), "en", "s")] * 30 + [("other text", "en", "t")] * 30
    for top in range(1, 11):
        got = divergence.source_divergence(spark.createDataFrame(rows, "text string, lang string, source string"), top=top)
        assert [x.item for x in got.where("part = 'term' AND source = 's'").orderBy("rank").collect()] == sorted(words, key=str.encode)[:top]
        if top == 3:
            assert divergence.source_divergence(spark.createDataFrame(rows[:0], "text string, lang string, source string")).collect() == []
