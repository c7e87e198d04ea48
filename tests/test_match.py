"""Matching against brute force, and how many rows its joins make."""

from __future__ import annotations

import random

import __spark_entry__ as entry

from tessitura.operators import match

SONGS, RECORDS = "id long, k string, duration double", "record_id long, k string, record_duration double"


def _nearest(songs, records, tolerance, apart):
    best: dict = {}
    for i, k, d in songs:
        for r, rk, rd in records:
            if k is None or rk != k or (apart and (i is None or r == i)):
                continue
            off = abs((rd or 0.0) - d) if d else 0.0
            if off <= tolerance:
                best[i] = min(best.get(i, (off, r)), (off, r))
    return sorted((i, r, off) for i, (off, r) in best.items())


def _counted(df, kinds: str, metric: str) -> int:
    """A figure of a collected table's steps of some kind, added up."""

    def count(plan) -> int:
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return count(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return count(plan.plan())
        own = plan.metrics().get(metric).get().value() if kinds in kind else 0
        return own + sum(count(plan.children().apply(n)) for n in range(plan.children().size()))

    return count(df._jdf.queryExecution().executedPlan())


def test_nearest_length_equals_brute_force(spark):
    dice = random.Random(5)
    lengths = [None, 0.0, -3.0, 0.5, 1.0, 7.9, 8.0, 16.0, 24.1, 1e300, float("inf"), float("nan")]
    for apart in (False, True):
        for tolerance in (8, 0, 2.5):
            # few ids in few keys: many records are a song's own, and of several lengths
            rows = [[(dice.randrange(9), dice.choice("abcd"), dice.choice([*lengths, *map(float, range(-6, 40, 2))])) for _ in range(n)] for n in (60, 25)]
            rows[0] += [(50, None, 1.0), (51, "own", 5.0), (51, "own", None)]
            rows[1] += [(50, None, 1.0), (51, "own", 5.0), (51, "own", 4.0), (51, "own", -1.0), (52, "own", -2.5)]
            found = match.nearest_duration(spark.createDataFrame(rows[0], SONGS), spark.createDataFrame(rows[1], RECORDS), ["k"], tolerance, apart)
            assert sorted(map(tuple, found.collect())) == _nearest(*rows, tolerance, apart)


def test_nearest_length_does_not_meet_all_of_a_key(spark, tmp_path):
    n = 400
    parts = [(i, "same", "one", None if i % 50 == 7 else i % 40) for i in range(n)]
    spark.createDataFrame([*parts, (n, "alone", "two", 5), (n + 1, "alone", "two", None)], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = entry.queries()["nearest_duration"](spark, str(tmp_path))
    got = sorted(map(tuple, found.collect()))
    songs, records = [(i, k, s) for i, k, _, s in parts if s], [(i, k, s) for i, k, _, s in parts if s is not None]
    assert got == _nearest(songs, records, 8, True)
    assert _counted(found, "Join", "numOutputRows") <= 2 * n


def test_containment_shuffles_no_pairs(spark):
    titles = [(i, "a" * 50 + "b" * i) for i in range(40)]
    names = [(f"n{i}", "a" * (5 + i)) for i in range(40)]
    found = match.contained(spark.createDataFrame(titles, "t long, title string"), spark.createDataFrame(names, "n string, name string"), "t", "title", "n", "name")
    assert sorted((r.t, r.n) for r in found.collect()) == sorted((t, n) for t, _ in titles for n, _ in names)
    assert _counted(found, "ShuffleExchangeExec", "shuffleRecordsWritten") < len(titles) * len(names)


def test_containment_is_exact_by_parts_of_names(spark, monkeypatch):
    dice = random.Random(3)
    word = lambda n: "".join(dice.choice("ab𠀀石") for _ in range(n))
    titles = [(i, word(dice.randrange(60))) for i in range(60)]
    names = [(i, word(dice.randrange(1, 12))) for i in range(80)] + [(80 + i, t[dice.randrange(5) :][: dice.randrange(9, 50)]) for i, (_, t) in enumerate(titles)]
    monkeypatch.setattr(match, "HELD", 40)  # names in four parts
    found = match.contained(spark.createDataFrame(titles, "t long, title string"), spark.createDataFrame(names, "n long, name string"), "t", "title", "n", "name")
    assert sorted(map(tuple, found.collect())) == sorted((t, n, title, name) for t, title in titles for n, name in names if name and name in title)
