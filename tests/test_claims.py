"""Claims of many workers equal a loop that serves one after the other."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessitura.operators import claims
from tessitura.operators.browse import numbered

TASKS = "task_id long, kind string, state string, created_at long, worker_id string, claim_token string, attempts int, lease_expires double"
REQUESTS = "turn long, worker_id string, kinds array<string>, token string"


def serial(tasks, requests):
    free = sorted((c, i, k) for i, k, s, c, *_ in tasks if s == "waiting")
    out = []
    for turn, worker, kinds, _ in sorted(requests):
        task = next((t for t in free if kinds and t[2] in kinds), None)
        if task:
            free.remove(task)
            out.append((turn, worker, task[1]))
    return out


@pytest.mark.parametrize("seed, block", [(1, 7), (2, 1000)])
def test_no_task_twice_and_as_if_in_turn(spark, seed, block):
    r = random.Random(seed)
    tasks = [(i, r.choice("abc"), r.choice(["waiting", "waiting", "running"]), r.randint(0, 40), None, None, 0, 0.0) for i in range(120)]
    requests = [(i, f"w{i % 9}", r.choice([["a"], ["b"], ["a", "b"], ["a", "b", "c"], ["c", "zz"], [], None]), f"t{i}") for i in range(100)]
    table, asked = spark.createDataFrame(tasks, TASKS), spark.createDataFrame(requests, REQUESTS)
    got = sorted(map(tuple, claims.assigned(table, asked, block).collect()))
    assert got == serial(tasks, requests) and len({t for *_, t in got}) == len(got)


def test_claimed_tasks_carry_worker_token_and_attempt(spark):
    tasks = [(1, "a", "running", 5, "old", "x", 1, 10.0), (2, "a", "waiting", 1, None, None, 0, 0.0), (3, "b", "done", 0, None, None, 1, 0.0), (4, "b", "running", 0, "held", "y", 1, 99.0)]
    requests = [(1, "w1", ["a", "b"], "t1"), (2, "w2", ["a"], "t2"), (3, "w3", ["a", "b"], "t3")]
    got = claims.all_claimed(spark.createDataFrame(tasks, TASKS), spark.createDataFrame(requests, REQUESTS), 50.0, 60.0).orderBy("task_id").collect()
    assert [(r.task_id, r.state, r.worker_id, r.claim_token, r.attempts, r.lease_expires) for r in got] == [
        (1, "running", "w2", "t2", 2, 110.0), (2, "running", "w1", "t1", 1, 110.0), (3, "done", None, None, 1, 0.0), (4, "running", "held", "y", 1, 99.0),
    ]


def test_nothing_to_give_and_nobody_to_ask(spark):
    tasks, asked = spark.createDataFrame([], TASKS), spark.createDataFrame([(1, "w", ["a"], "t")], REQUESTS)
    assert claims.assigned(tasks, asked).collect() == []
    one = spark.createDataFrame([(1, "a", "waiting", 0, None, None, 0, 0.0)], TASKS)
    assert claims.assigned(one, asked.where(F.lit(False))).collect() == []


def test_row_numbers_of_many_rows_are_whole(spark):
    many = spark.range(0, 100_000, 1, 4).select((F.col("id") * 7919 % 100_003).alias("x"), F.concat(F.lit("w"), "id").alias("other"))
    got = sorted((r.row, r.x) for r in numbered(many, ["x"]).where("other <> ''").collect())
    assert [n for n, _ in got] == list(range(1, 100_001)) and [x for _, x in got] == sorted(x for _, x in got)


def test_a_round_moves_packed_blocks_and_counts_only(spark, monkeypatch):
    r = random.Random(5)
    tasks = [(i, r.choice("abc"), "waiting", r.randint(0, 40), None, None, 0, 0.0) for i in range(400)]
    requests = [(i, None if i % 7 == 0 else f"w{i % 9}", r.choice([["a"], ["b", None], ["a", "b"], ["a", "b", "c"], ["c", "zz"]]), f"t{i}") for i in range(300)]
    met, rounds = claims._met, []

    def seen(turns, queue, starts, totals, block):
        rounds.append((turns.columns, turns.count(), queue.columns, queue.count(), dict(starts)))
        return met(turns, queue, starts, totals, block)

    monkeypatch.setattr(claims, "_met", seen)
    got = sorted(map(tuple, claims.assigned(spark.createDataFrame(tasks, TASKS), spark.createDataFrame(requests, REQUESTS), 12).collect()))
    assert got == serial(tasks, [(t, w, [k for k in kinds if k], token) for t, w, kinds, token in requests])
    *plays, last = rounds
    assert all(x[:4] == (["block", "kinds"], 25, ["kind", "chunk", "ranks"], plays[0][3]) for x in plays) and plays[0][3] <= 37
    assert sum(len(x[4]) for x in plays) <= 2 * 25 + claims.WIDTH
    assert len(last[4]) == 25 and all(a[4].get(b) != n for a, c in zip(plays, plays[1:]) for b, n in c[4].items())
