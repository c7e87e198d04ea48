"""Claims of many workers at once: every task goes to one worker, as if the workers had asked one after the other.

A worker gets the oldest waiting task of its kinds, so all that earlier workers mean to a later one is how many tasks of each
kind they took. Workers are cut into blocks by turn, and several blocks are played at the same time from a guess of those counts. Where the
blocks before took other numbers than guessed, a block is played again. The first block of a round always started right, so rounds
end. A round plays twice the blocks that the last one got right, so all rounds together play little more than twice the blocks there are;
blocks of workers and of the queue are packed, a row each, only counts come back, and tasks are given out once, at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessitura.operators.browse import numbered
from tessitura.operators.rooms import requeued
from tessitura.sources.shared import kept

#: Workers of a block: what one task plays in order. Blocks of the first round; a later one plays twice as many as were right in the one before.
BLOCK, WIDTH = 10_000, 8


def assigned(tasks: DataFrame, requests: DataFrame, block: int = BLOCK) -> DataFrame:
    """Requests (turn, worker_id, kinds) that get a task: turn, worker_id, task_id. Tasks: task_id, kind, state, created_at.

    Turns differ. A request is served after all of smaller turn, with the waiting task of its kinds that is oldest (then of
    the smallest id) and still free. Kinds that no task has, null kinds and empty lists get nothing.
    """
    spark = tasks.sparkSession
    waiting = tasks.where("state = 'waiting' AND kind IS NOT NULL").select("kind", "created_at", "task_id")
    ranked = numbered(waiting, ["created_at", "task_id", "kind"]).select("kind", "task_id", F.col("row").alias("rank"))
    placed = numbered(ranked, ["kind", "rank"])
    # a row for each kind and block of places: its tasks in order
    first = placed.groupBy("kind").agg(F.min("row").alias("first"))
    placed = placed.join(F.broadcast(first), "kind").withColumn("place", F.col("row") - F.col("first"))
    own = F.array_sort(F.collect_list(F.struct("rank", "task_id")))
    queue = kept(placed.groupBy("kind", F.expr(f"place div {block}").alias("chunk")).agg(own.alias("own")).select("kind", "chunk", F.col("own.rank").alias("ranks"), F.col("own.task_id").alias("task_ids")))
    totals = {r["kind"]: r["n"] for r in queue.groupBy("kind").agg(F.sum(F.size("ranks")).alias("n")).collect()}  # kinds of work: a handful
    out = f"turn {_type(requests, 'turn')}, worker_id {_type(requests, 'worker_id')}, task_id {_type(tasks, 'task_id')}"
    if not totals:
        return spark.createDataFrame([], out)
    # a row for each block of requests: in order of turn, the kinds by their numbers
    names = F.array(*map(F.lit, totals))
    kinds = F.filter(F.transform("kinds", lambda k: F.array_position(names, k).cast("int") - 1), lambda n: n >= 0)
    asked = numbered(requests.select("turn", "worker_id", F.coalesce(kinds, F.array().cast("array<int>")).alias("kinds")), ["turn"])
    own = F.array_sort(F.collect_list(F.struct("row", "turn", "worker_id", "kinds")))
    asked = asked.groupBy(F.expr(f"(row - 1) div {block}").alias("block")).agg(own.alias("own"))
    turns = kept(asked.select("block", F.col("own.turn").alias("turns"), F.col("own.worker_id").alias("workers"), F.col("own.kinds").alias("kinds")))
    blocks = turns.count()
    every = sum(totals.values())
    starts = {b: tuple(min(n, b * block * n // every) for n in totals.values()) for b in range(blocks)}
    took: dict[int, tuple] = {}  # of each block, what it took from `tried`
    tried: dict[int, tuple] = {}
    at, width = 0, WIDTH
    while at < blocks:
        open_ = {b: starts[b] for b in range(at, min(blocks, at + width)) if tried.get(b) != starts[b]}
        for r in _met(turns.select("block", "kinds"), queue.select("kind", "chunk", "ranks"), open_, totals, block).applyInArrow(_counted(len(totals)), "block long, took array<long>").collect():
            took[r["block"]] = tuple(r["took"])
        tried |= open_
        # blocks are right as far as each began where the one before ended; those not played yet are guessed to take what the last one took
        began, state, last = at, starts[at], (0,) * len(totals)
        for b in range(at, blocks):
            if at == b and tried.get(b) == state:
                at = b + 1
            starts[b] = state
            last = took.get(b, last)
            state = tuple(min(x + y, n) for x, y, n in zip(state, last, totals.values(), strict=True))
        width = 2 * (at - began)
    return _met(turns, queue, starts, totals, block).applyInArrow(_given(to_arrow_schema(StructType.fromDDL(out))), out)


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _met(turns: DataFrame, queue: DataFrame, starts: dict[int, tuple], totals: dict, block: int):
    """The blocks of `starts`, each with the chunks of the queue that it can reach: as many tasks of each kind as it has requests."""
    spans = [(b, k, n, kind, chunk) for b, own in starts.items() for k, (n, kind) in enumerate(zip(own, totals, strict=True)) for chunk in (n // block, n // block + 1)]
    spans = queue.sparkSession.createDataFrame(spans, f"block long, k int, start long, kind {_type(queue, 'kind')}, chunk long")
    near = queue.join(F.broadcast(spans), ["kind", "chunk"]).withColumn("skip", F.greatest(F.lit(0), F.col("start") - F.col("chunk") * block)).drop("kind", "start")
    own = turns.join(F.broadcast(spans.select("block").distinct()), "block")
    return own.groupBy("block").cogroup(near.groupBy("block"))


def _played(kinds: list[list[int]], tasks: pa.Table) -> Iterator[tuple[int, int, int]]:
    """For each request served: its place in the block, the kind, and how many tasks of that kind were taken before."""
    heads: dict[int, list[int]] = {}
    for k, _, skip, ranks in sorted(zip(*(tasks[c].to_pylist() for c in ("k", "chunk", "skip", "ranks")), strict=True), key=lambda r: r[:2]):
        heads.setdefault(k, []).extend(ranks[skip:])
    taken = dict.fromkeys(heads, 0)
    for nth, own in enumerate(kinds):
        free = [(heads[k][taken[k]], k) for k in own if k in heads and taken[k] < len(heads[k])]
        if free:
            k = min(free)[1]
            yield nth, k, taken[k]
            taken[k] += 1


def _counted(kinds: int):
    """How many tasks of each kind a block takes."""

    def play(requests: pa.Table, tasks: pa.Table) -> pa.Table:
        took = [0] * kinds
        for _, k, _ in _played(requests["kinds"][0].as_py(), tasks):
            took[k] += 1
        return pa.table({"block": requests["block"], "took": pa.array([took], pa.list_(pa.int64()))})

    return play


def _given(schema: pa.Schema):
    """What each request of a block gets."""

    def play(requests: pa.Table, tasks: pa.Table) -> pa.Table:
        ids: dict[int, list] = {}
        for k, _, skip, own in sorted(zip(*(tasks[c].to_pylist() for c in ("k", "chunk", "skip", "task_ids")), strict=True), key=lambda r: r[:2]):
            ids.setdefault(k, []).extend(own[skip:])
        turns, workers = requests["turns"][0].as_py(), requests["workers"][0].as_py()
        rows = [(turns[nth], workers[nth], ids[k][n]) for nth, k, n in _played(requests["kinds"][0].as_py(), tasks)]
        return pa.table([pa.array([r[c] for r in rows], field.type) for c, field in enumerate(schema)], schema=schema)

    return play


def all_claimed(tasks: DataFrame, requests: DataFrame, now: float, lease: float, block: int = BLOCK) -> DataFrame:
    """Tasks after the claims of many workers (turn, worker_id, kinds, token): late ones wait again first; each claimed task is
    its worker's own under the worker's token, with one attempt more."""
    tasks = requeued(tasks, now)
    own = assigned(tasks, requests, block).join(requests.select("turn", F.col("token").alias("_token")), "turn")
    own = own.select("task_id", F.col("worker_id").alias("_worker"), "_token")
    met, yes = tasks.join(own, "task_id", "left"), F.col("_worker").isNotNull()
    kind = lambda c: tasks.schema[c].dataType
    return met.withColumns({
        "state": F.when(yes, "running").otherwise(F.col("state")),
        "worker_id": F.coalesce(F.col("_worker").cast(kind("worker_id")), "worker_id"),
        "claim_token": F.coalesce("_token", "claim_token"),
        "attempts": (F.col("attempts") + yes.cast("int")).cast(kind("attempts")),
        "lease_expires": F.when(yes, F.lit(now + lease).cast(kind("lease_expires"))).otherwise(F.col("lease_expires")),
    }).drop("_worker", "_token")
