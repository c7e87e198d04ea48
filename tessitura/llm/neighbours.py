"""Nearest neighbours by vantage-point trees, one for each shard of the vectors.

A small tree over a bounded sample deals all vectors into shards of near ones, a large leaf into several shards. Each shard has a tree of
its own: a node splits its vectors at the median distance from one of them. By the triangle inequality a vector on the other side of
a sphere is at least as far from a query as the query is from the sphere; a side goes unread if that bound, times `factor`, is above the
distance of the k-th best found so far. Factor one never loses a neighbour, larger ones read less.

A query first searches the shard it lies in, which bounds the distance of its k-th neighbour. Then blocks of queries are dealt to the shards
that the bound leaves open. Distances that count are summed component by component in double precision; a matrix product only
sorts out what is clearly too far.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, written
from .vector_codes import clean_vectors, common_length, matrix

#: Rows of the sample that the tree over all shards is fitted on, and its leaves at most.
SAMPLE_ROWS, SHARD_LEAVES = 8192, 256
#: Rows of a query block, and blocks that meet a shard in one task.
BLOCK_ROWS, GROUP_BLOCKS = 1024, 16
#: Vectors tried as vantage point, and vectors that they are tried on.
TRIED, TRIED_ON = 8, 64
#: What rounding may add to a bound, as a share of the distances it comes from.
SLACK = 1e-9


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, components summed in order."""
    with np.errstate(over="ignore", invalid="ignore"):
        total = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
        for j in range(a.shape[-1]):
            d = a[..., j] - b[..., j]
            total += d * d
        return np.sqrt(total)


@dataclass
class Tree:
    """vantage, radius: of the nodes, level by level from the root; leaves are in order, those within a sphere first."""

    vantage: np.ndarray
    radius: np.ndarray

    @property
    def leaves(self) -> int:
        return len(self.radius) + 1

    @classmethod
    def build(cls, x: np.ndarray, levels: int) -> tuple[Tree, list[np.ndarray]]:
        """A tree with 2**levels leaves, and the rows of each."""
        groups, vantage, radius = [np.arange(len(x))], [], []
        for _ in range(levels):
            split = []
            for rows in groups:
                if not len(rows):
                    vantage.append(np.zeros(x.shape[1]))
                    radius.append(0.0)
                    split += [rows, rows]
                    continue
                some = x[rows[:: max(1, len(rows) // TRIED_ON)][:TRIED_ON]]
                tried = rows[:: max(1, len(rows) // TRIED)][:TRIED]
                spread = [np.nan_to_num(distances(some, x[t][None, :]), posinf=0).std() for t in tried]
                point = x[tried[int(np.argmax(spread))]]
                far = distances(x[rows], point[None, :])
                middle = float(np.median(far))
                vantage.append(point)
                radius.append(middle)
                split += [rows[far <= middle], rows[far > middle]]
            groups = split
        return cls(np.array(vantage).reshape(len(vantage), x.shape[1]), np.array(radius, np.float64)), groups

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row falls into."""
        at, first, width = np.zeros(len(x), np.int64), 0, 1
        while first < len(self.radius):
            node = first + at
            at = 2 * at + (distances(x, self.vantage[node]) > self.radius[node])
            first, width = first + width, 2 * width
        return at

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """For each row and leaf a distance that no vector of the leaf is nearer than."""
        low, first, width = np.zeros((len(x), 1)), 0, 1
        while first < len(self.radius):
            radius = self.radius[first : first + width]
            far = distances(x[:, None, :], self.vantage[None, first : first + width, :])
            with np.errstate(invalid="ignore"):
                slack = SLACK * (far + radius)
                sides = np.stack([far - radius - slack, radius - far - slack], axis=2)
            low = np.maximum(low[:, :, None], np.nan_to_num(sides, nan=0.0, posinf=np.inf, neginf=0.0)).reshape(len(x), -1)
            first, width = first + width, 2 * width
        return low


class Shard:
    """The vectors of a shard, leaf after leaf, under their tree."""

    def __init__(self, tree: Tree, ids: np.ndarray, points: np.ndarray, ends: np.ndarray):
        self.tree, self.ids, self.points, self.ends = tree, ids, points, ends
        self.norms = (points * points).sum(axis=1)
        self.repeats = len(np.unique(ids)) < len(ids)

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray, leaf_rows: int) -> Shard:
        order = np.argsort(ids, kind="stable")
        ids, points = ids[order], points[order]
        levels = max(0, int(np.ceil(np.log2(max(len(ids), 1) / leaf_rows))))
        tree, groups = Tree.build(points, levels)
        rows = np.concatenate(groups)
        return cls(tree, ids[rows], points[rows], np.cumsum([len(g) for g in groups]))

    def columns(self) -> list[bytes]:
        return [v.tobytes() for v in (self.ids, self.points, self.ends, self.tree.vantage, self.tree.radius)]

    @classmethod
    def read(cls, columns: list[bytes], size: int) -> Shard:
        ids, points, ends, vantage, radius = (np.frombuffer(c, kind) for c, kind in zip(columns, (np.int64, np.float64, np.int64, np.float64, np.float64), strict=True))
        return cls(Tree(vantage.reshape(-1, size), radius), ids, points.reshape(-1, size), ends)

    def search(self, x: np.ndarray, own: np.ndarray, limit: np.ndarray, k: int, factor: float) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For each query the scores and ids of the k nearest (smaller ids first) not beyond its limit, and the limit that these leave."""
        scores, ids = [np.empty(0)] * len(x), [np.empty(0, np.int64)] * len(x)
        limit = limit.copy()
        low = self.tree.bounds(x)
        starts = np.concatenate([[0], self.ends[:-1]])
        nearest = low.argmin(axis=1)
        norms = (x * x).sum(axis=1)
        done = np.zeros(low.shape, bool)
        for first in (True, False):  # the leaf most likely to hold the nearest, then all that are still open
            for leaf in range(self.tree.leaves):
                with np.errstate(over="ignore"):
                    ask = ~done[:, leaf] & (low[:, leaf] * factor <= limit)
                if first:
                    ask &= nearest == leaf
                rows = np.flatnonzero(ask)
                if not len(rows) or starts[leaf] == self.ends[leaf]:
                    continue
                done[rows, leaf] = True
                part = slice(starts[leaf], self.ends[leaf])
                with np.errstate(over="ignore", invalid="ignore"):
                    size = norms[rows, None] + self.norms[None, part]
                    rough = size - 2 * (x[rows] @ self.points[part].T)
                    near = ~(rough > limit[rows, None] ** 2 * (1 + SLACK) + SLACK * size)
                near &= self.ids[None, part] != own[rows, None]
                at, point = np.nonzero(near)
                if not len(at):
                    continue
                point = point + starts[leaf]
                exact = distances(x[rows[at]], self.points[point])
                cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    q = rows[at[a]]
                    score, who = np.concatenate([scores[q], exact[a:b]]), np.concatenate([ids[q], self.ids[point[a:b]]])
                    order = np.lexsort((who, score))
                    if self.repeats:  # an id counts with its nearest vector
                        order = order[np.sort(np.unique(who[order], return_index=True)[1])]
                    order = order[:k]
                    scores[q], ids[q] = score[order], who[order]
                    if len(order) == k:
                        limit[q] = min(limit[q], scores[q][-1])
        return scores, ids, limit


_INDEX = "shard long, ids binary, points binary, ends binary, vantage binary, radius binary"
_NAMES = ["shard", "ids", "points", "ends", "vantage", "radius"]


@dataclass
class Index:
    """tree: over all shards; shards: number of each leaf's shards; first: number of its first one; table: the shards' trees; placed: rows with leaf and turn."""

    tree: Tree
    shards: np.ndarray
    first: np.ndarray
    table: DataFrame
    placed: DataFrame
    size: int


def build_index(rows: DataFrame, shard_rows: int = 4096, leaf_rows: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> Index | None:
    """Trees over all vectors of a table; None without vectors. See `nearest` for rows that take no part."""
    spark = rows.sparkSession
    bound_batches(spark)
    vectors = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    vectors = vectors.where(clean_vectors(vectors, "embedding")).where("vec_id IS NOT NULL AND exists(embedding, x -> x <> 0)")
    size = common_length(vectors, "embedding")
    if not size:
        return None
    vectors = vectors.where(F.size("embedding") == size)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(SAMPLE_ROWS).collect()
    levels = int(np.ceil(np.log2(max(1, vectors.count() / shard_rows))))
    tree, _ = Tree.build(np.array([r["embedding"] for r in sample]), min(levels, int(np.log2(SHARD_LEAVES))))

    def place(batches):
        turns = np.zeros(tree.leaves, np.int64)  # rows of a leaf are dealt in turn, equal ones too
        for batch in batches:
            leaf = tree.leaf_of(matrix(batch.column(1), size))
            turn = np.empty(len(leaf), np.int64)
            for one in np.unique(leaf):
                rows = np.flatnonzero(leaf == one)
                turn[rows] = turns[one] + np.arange(len(rows))
                turns[one] += len(rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int64()), pa.array(turn, pa.int64())], names=["vec_id", "embedding", "leaf", "turn"])

    placed = written(vectors.mapInArrow(place, "vec_id long, embedding array<double>, leaf long, turn long"), "placed-vectors")
    counts = np.zeros(tree.leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():
        counts[r["leaf"]] = r["count"]
    shards = np.maximum(1, -(-counts // shard_rows))
    first = np.concatenate([[0], np.cumsum(shards)[:-1]])

    def grow(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        shard = Shard.build(group["vec_id"].to_numpy(), matrix(group["embedding"].chunk(0), size), leaf_rows)
        return pa.table([pa.array([group["shard"][0].as_py()], pa.int64()), *(pa.array([c], pa.binary()) for c in shard.columns())], names=_NAMES)

    dealt = placed.select("vec_id", "embedding", _shard_of(shards, first).alias("shard"))
    return Index(tree, shards, first, written(dealt.groupBy("shard").applyInArrow(grow, _INDEX), "vector-trees"), placed, size)


def _shard_of(shards: np.ndarray, first: np.ndarray):
    """The shard of a row (leaf, turn): numbers by leaf, at most SHARD_LEAVES, as literals."""
    of = lambda values: F.element_at(F.lit([int(v) for v in values]), (F.col("leaf") + 1).cast("int"))
    return of(first) + F.pmod(F.col("turn"), of(shards))


_FOUND = "query_id long, vec_id long, score double"


def _found(own: np.ndarray, scores: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
    sizes = [len(s) for s in scores]
    columns = [pa.array(np.repeat(own, sizes), pa.int64()), pa.array(np.concatenate([np.empty(0, np.int64), *ids]), pa.int64()), pa.array(np.concatenate([np.empty(0), *scores]), pa.float64())]
    return pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])


def search(index: Index, queries: DataFrame, k: int, factor: float) -> DataFrame:
    """query_id, vec_id, score: what the trees give for queries, rows of index.placed; more than k for a query, its k nearest among them."""
    size, tree, shards, firsts = index.size, index.tree, index.shards, index.first
    asked = queries.select(F.col("vec_id").alias("query_id"), "embedding", _shard_of(shards, firsts).alias("shard"))

    def at_home(_, left: pa.Table, right: pa.Table) -> pa.Table:
        """One shard and the queries that lie in it, packed into blocks with what they found."""
        own, right = Shard.read([left[c][0].as_py() for c in _NAMES[1:]], size), right.combine_chunks()
        out: list[tuple] = []
        if right.num_rows:
            names, x = right["query_id"].to_numpy(), matrix(right["embedding"].chunk(0), size)
            for at in range(0, len(names), BLOCK_ROWS):
                cut = slice(at, at + BLOCK_ROWS)
                scores, ids, limit = own.search(x[cut], names[cut], np.full(len(names[cut]), np.inf), k, factor)
                home = right["shard"][0].as_py()
                out.append((home, at // BLOCK_ROWS, names[cut].tobytes(), x[cut].tobytes(), limit.tobytes(), np.array([len(s) for s in scores], np.int64).tobytes(), np.concatenate(ids).tobytes(), np.concatenate(scores).tobytes()))
        columns = list(zip(*out, strict=True)) if out else [()] * 8
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 6]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=_BLOCK_NAMES)

    blocks = index.table.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(at_home, _BLOCKS)
    blocks = written(blocks, "query-blocks")

    def own_found(batches):
        for batch in batches:
            for own, sizes, ids, scores in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                ends = np.cumsum(np.frombuffer(sizes, np.int64))[:-1]
                yield _found(np.frombuffer(own, np.int64), np.split(np.frombuffer(scores, np.float64), ends), np.split(np.frombuffer(ids, np.int64), ends))

    def open_shards(batches):
        """home, block -> the other shards where a query of the block may have nearer vectors."""
        for batch in batches:
            for home, block, x, limit in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                low, most = tree.bounds(np.frombuffer(x, np.float64).reshape(-1, size)), np.frombuffer(limit, np.float64)
                with np.errstate(over="ignore"):
                    leaves = np.flatnonzero((low * factor <= most[:, None]).any(axis=0))
                every = np.concatenate([np.empty(0, np.int64), *(np.arange(firsts[e], firsts[e] + shards[e]) for e in leaves)])
                every = every[every != home]
                columns = [np.full(len(every), home), np.full(len(every), block), every]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["home", "block", "shard"])

    # a block meets each open shard once; a shard's blocks are spread over several tasks
    pairs = blocks.select("home", "block", "vectors", "limits").mapInArrow(open_shards, "home long, block long, shard long")
    groups = max(1, -(-blocks.count() // GROUP_BLOCKS))
    pairs = pairs.withColumn("turn", F.pmod(F.xxhash64("home", "block"), F.lit(groups)))
    copies = index.table.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    met = pairs.join(blocks.select("home", "block", "queries", "vectors", "limits"), ["home", "block"]).join(copies, ["shard", "turn"])

    def elsewhere(batches):
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
                own = np.frombuffer(row[0], np.int64)
                scores, ids, _ = Shard.read(list(row[3:]), size).search(np.frombuffer(row[1], np.float64).reshape(-1, size), own, np.frombuffer(row[2], np.float64), k, factor)
                yield _found(own, scores, ids)

    more = met.select("queries", "vectors", "limits", *_NAMES[1:]).mapInArrow(elsewhere, _FOUND)
    return blocks.select("queries", "sizes", "ids", "scores").mapInArrow(own_found, _FOUND).unionByName(more)


_BLOCK_NAMES = ["home", "block", "queries", "vectors", "limits", "sizes", "ids", "scores"]
_BLOCKS = "home long, block long, queries binary, vectors binary, limits binary, sizes binary, ids binary, scores binary"


def nearest(rows: DataFrame, every: int = 100, k: int = 10, factor: float = 1.0, shard_rows: int = 4096, leaf_rows: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors of each row whose id `every` divides, by Euclidean distance, ties by the smaller id.

    factor: 1 finds all neighbours; larger ones cut off more (README has recall and share of vectors read).

    Rows with a null id, or whose vector is null, empty, zero or holds null or non-finite components take no part, nor do those whose length
    isn't the most frequent one. Repeated rows count once. An id with several vectors stands for all of them: its distances are those of its
    nearest, and it isn't its own neighbour. Queries with fewer candidates than k get all. Other columns are ignored; an empty table gives an
    empty result.
    """
    if factor < 1:
        raise ValueError("factor: 1 or more")
    index = build_index(rows, shard_rows, leaf_rows, id_col, vector_col)
    if index is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = search(index, index.placed.where(F.col("vec_id") % every == 0), k, factor)
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
