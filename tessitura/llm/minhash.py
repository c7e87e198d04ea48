"""Near-duplicate groups: banded MinHash candidates, sequential Bayesian pruning, exact verification.

Stages, all over tables:

1. Texts with equal word sequences are one class; the smallest id stands for it.
2. Each class gets a signature of `PERMS` minima, cut into bands of `ROWS` values. Classes that share
   a band are candidates.
3. First each class is compared with the smallest member of its buckets (a star, not all pairs): the
   signatures are read batch by batch and a pair is dropped as soon as the posterior probability that
   its similarity reaches the threshold falls below `MISS`. The best survivor of each class is
   verified on the full shingle sets, and verified links form components.
4. Buckets whose members are not all in one component are then searched in blocks for links that cross
   components: signatures batch by batch as before, survivors exactly on the full sets, each pair in the
   first band that it shares only. A class stops at a component once it is linked to it. So every candidate pair
   is in one component, pruned by the posterior bound, or verified exactly, and only links leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, checked_broadcast, components, numbered, worker_state, written
from .words import sequence_digest, text_column, word_hashes

#: Words of a shingle, least similarity of a link (as NEED of 100).
SHINGLE, NEED = 5, 75
#: Hash functions; values of a band. 32 bands of 4 miss a pair at similarity 0.75 with probability 5e-6.
PERMS, ROWS = 128, 4
#: Signature values read between two looks at the posterior, and the miss probability of each look.
BATCH, MISS = 32, 1e-6
#: Members of a block in the search of a bucket, and bytes of their shingle sets together (a larger set is alone).
BLOCK, BLOCK_BYTES = 512, 4 << 20

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 2**63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, PERMS, dtype=np.uint64)


def prune_bounds(need: int = NEED, batch: int = BATCH, perms: int = PERMS, miss: float = MISS) -> list[int]:
    """For each look after n = batch, 2 * batch, ... values: the least number of equal values that stays.

    With a uniform prior the similarity given m equal values of n is Beta(m + 1, n - m + 1), whose
    tail above t is the binomial sum over j <= m of C(n + 1, j) t^j (1 - t)^(n + 1 - j).
    """
    t, bounds = need / 100, []
    for n in range(batch, perms + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        bounds.append(m)
    return bounds


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For blocks of the texts of a column: number of the first text, counts, and the distinct shingle hashes, sorted in each text.

    A text of fewer words than a shingle, but not none, has its whole sequence as its one shingle.
    """
    for first, hashes, counts in word_hashes(column):
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        made = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1)).astype(np.int64)
        total = int(made.sum())
        if not total:
            yield first, made, np.empty(0, np.uint64)
            continue
        owner = np.repeat(np.arange(len(counts)), made)
        begin = np.arange(total) - np.repeat(np.cumsum(made) - made, made) + starts[owner]
        width = np.minimum(counts, shingle)[owner]
        acc = np.zeros(total, np.uint64)
        padded = np.concatenate([hashes, np.zeros(shingle, np.uint64)])
        for k in range(shingle):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + np.where(k < width, padded[begin + k], np.uint64(0))
            acc ^= acc >> np.uint64(29)
        acc *= np.uint64(0xBF58476D1CE4E5B9)
        acc ^= acc >> np.uint64(32)
        order = np.lexsort((acc, owner))
        acc, owner = acc[order], owner[order]
        fresh = np.ones(total, bool)
        fresh[1:] = (acc[1:] != acc[:-1]) | (owner[1:] != owner[:-1])
        yield first, np.bincount(owner[fresh], minlength=len(counts)).astype(np.int64), acc[fresh]


def signatures(counts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """uint32 minima, one row for each text that has shingles."""
    full = counts[counts > 0]
    out = np.empty((len(full), PERMS), np.uint32)
    if not len(full):
        return out
    starts = np.cumsum(full) - full
    work = np.empty_like(hashes)
    for i in range(PERMS):
        np.multiply(hashes, _MUL[i], out=work)
        np.add(work, _ADD[i], out=work)
        out[:, i] = np.minimum.reduceat(work, starts) >> np.uint64(32)
    return out


def _sequence_keys(batches):
    """number, text, id -> number, key of the word sequence (null without words), number of distinct shingles, signature, id."""
    worker_state("minhash")
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        n_shingles = np.zeros(len(ids), np.int64)
        sigs: list[bytes | None] = [None] * len(ids)
        for first, counts, hashes in shingle_sets(texts):
            sig = signatures(counts, hashes)
            n_shingles[first : first + len(counts)] = counts
            for row, at in enumerate(np.flatnonzero(counts)):
                sigs[first + at] = sig[row].tobytes()
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(sequence_digest(texts), pa.binary()), pa.array(n_shingles), pa.array(sigs, pa.binary()), batch.column(2)],
            names=["doc_id", "seq", "n_shingles", "sig", "id"],
        )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id, kept.

    Words are runs other than blanks of the text with A-Z lower-cased. Documents are linked when the
    sets of their 5-word shingles have a Jaccard similarity of 0.75 or more; component_id is the
    smallest id reachable. A text without words (null, empty, blank) has no set and is linked with
    nothing; a text of fewer than five words has its whole sequence as its only shingle. Equal texts
    are linked through their class. Every row is judged on its own text, also where ids repeat; null ids are larger
    than any, so component_id is null where a component has no other. row_col: a column that numbers the rows, if there
    is one. Other columns are ignored; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    rows, at = (docs, row_col) if row_col else numbered(docs, id_col, text_col)
    rows = rows.select(F.col(at).alias("doc_id"), text_column(F.col(text_col)).alias("text"), F.col(id_col).cast("long").alias("id"))
    signed = written(
        rows.mapInArrow(_sequence_keys, "doc_id long, seq binary, n_shingles long, sig binary, id long"), "signatures"
    )
    have = signed.where("seq is not null")
    classes = written(have.groupBy("seq").agg(F.min("doc_id").alias("rep")), "word-classes")
    reps = written(
        have.join(classes.withColumnRenamed("rep", "doc_id"), ["seq", "doc_id"]).select("doc_id", "n_shingles", "sig"), "class-signatures"
    )
    roots = _linked(reps, rows.select("doc_id", "text"))
    placed = (
        signed.select("doc_id", "id", "n_shingles", "seq")
        .join(classes, "seq", "left")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select("id", "n_shingles", F.coalesce("root", "rep", "doc_id").alias("root"))
    )
    placed = written(placed, "placed")
    # a class that is alone needs no look-up, so what is joined are groups only, and seldom too many to broadcast
    groups = placed.groupBy("root").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "least")
    out = placed.join(checked_broadcast(written(groups, "groups")), "root", "left").withColumn("component_id", F.coalesce("least", "id"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _bands(batches):
    step = PERMS // ROWS
    for batch in batches:
        n = batch.num_rows
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, step, ROWS).astype(np.uint64)
        key = np.zeros((n, step), np.uint64)
        for r in range(ROWS):
            key = (key ^ sig[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
        key = (key & ~np.uint64(31)) | np.arange(step, dtype=np.uint64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(batch.column(0).to_numpy(), step)), pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column(2).to_numpy(), step))],
            names=["doc_id", "band", "n_shingles"],
        )


def _survivors(batches):
    """Pairs with both signatures -> pairs that no look drops, with their number of equal values."""
    bounds = prune_bounds()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(n, PERMS) for k in (2, 3))
        alive, same = np.arange(n), np.zeros(n, np.int64)
        for look, least in enumerate(bounds):
            cut = slice(look * BATCH, (look + 1) * BATCH)
            same[alive] += (a[alive, cut] == b[alive, cut]).sum(axis=1)
            alive = alive[same[alive] >= least]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive)), pa.array(same[alive])],
            names=["a", "b", "same"],
        )


def _linked(reps: DataFrame, texts: DataFrame) -> DataFrame:
    """node, root of every class that has a verified link."""
    bands = written(reps.select("doc_id", "sig", "n_shingles").mapInArrow(_bands, "doc_id long, band long, n_shingles long"), "bands")
    pivots = bands.groupBy("band").agg(F.min("doc_id").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(bands.join(pivots, "band"), "shared-bands")
    star = shared.where("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct()
    sig = reps.select("doc_id", "sig")
    met = star.join(sig.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), "a").join(
        sig.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb")), "b"
    )
    alive = met.select("a", "b", "sa", "sb").mapInArrow(_survivors, "a long, b long, same long")
    best = alive.groupBy("a").agg(F.max_by("b", F.struct("same", -F.col("b"))).alias("b"))
    links = written(_verified(best, texts).where("linked").select("a", "b"), "star-links")
    roots = written(components(links), "roots")
    more = written(_crossing(shared, roots, sig, texts), "crossing-links")
    if more.isEmpty():
        return roots
    return written(components(links.unionByName(more)), "roots")


def _crossing(shared: DataFrame, roots: DataFrame, sig: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between components: a, b.

    A bucket's members outside its largest component face all its members, block against block, so
    no task holds more than two blocks and pairs within a component are not formed. First only signatures meet; full sets
    are brought to those cells, and for those members, that a signature has left open.
    """
    place = shared.select("band", "doc_id", "n_shingles").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    place = written(place.select("band", "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("root")), "placed-bands")
    sizes = place.groupBy("band", "root").agg(F.count(F.lit(1)).alias("c"), (F.sum("n_shingles") * 8).alias("bytes"))
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("long")
    most = F.max(F.struct("c", -F.col("root"), "bytes"))
    mixed = (
        sizes.groupBy("band")
        .agg(F.max_by("root", F.struct("c", -F.col("root"))).alias("major"), F.count(F.lit(1)).alias("k"), F.sum("c").alias("n"), F.sum("bytes").alias("bytes"), most.alias("m"))
        .where("k > 1")
        .select("band", "major", blocks(F.col("n"), F.col("bytes")).alias("blocks"), blocks(F.col("n") - F.col("m.c"), F.col("bytes") - F.col("m.bytes")).alias("minor_blocks"))
    )
    open_ = written(place.join(mixed, "band"), "open-buckets")
    every = open_.select("band", "doc_id", "root", "major", F.lit(False).alias("minor"), F.pmod(F.xxhash64("doc_id"), "blocks").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("minor_blocks") - 1)).alias("j"))
    few = open_.where("root <> major").select(
        "band", "doc_id", "root", "major", F.lit(True).alias("minor"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("i"), F.pmod(F.xxhash64("doc_id"), "minor_blocks").alias("j")
    )
    cells = written(every.unionByName(few), "cells")
    sizes = open_.select("doc_id", "n_shingles").distinct()
    own = written(sig.join(sizes, "doc_id"), "open-signatures")
    left = _in_cells(cells.join(own, "doc_id"), "n_shingles").mapInArrow(_cell_open, "band long, i long, j long, minor boolean, doc_id long")
    left = written(left, "open-members")
    if left.isEmpty():
        return left.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    used = checked_broadcast(written(left.select("doc_id").distinct(), "open-ids"))
    sets = written(texts.join(used, "doc_id").mapInArrow(_sets, "doc_id long, set binary"), "open-sets")
    met = cells.join(left, ["band", "i", "j", "minor", "doc_id"], "left_semi").join(own, "doc_id").join(sets, "doc_id")
    return _in_cells(met, "set").mapInArrow(_cell_links, "a long, b long").distinct()


def _in_cells(members: DataFrame, last: str) -> DataFrame:
    """Members cell by cell, those of block i before the minor ones of block j."""
    return (
        members.repartition("band", "i", "j")
        .sortWithinPartitions("band", "i", "j", "minor", "doc_id")
        .select("band", "i", "j", "minor", "doc_id", F.struct("root", "major").alias("at"), "sig", last)
    )


def _linked_sets(p: np.ndarray, q: np.ndarray) -> bool:
    """Exact test of two sorted sets, without the intersection where their sizes rule it out."""
    if 100 * min(len(p), len(q)) < NEED * max(len(p), len(q)):
        return False
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both > 0 and 100 * both >= NEED * (len(p) + len(q) - both)


def _cells(batches):
    """(band, i, j) and the rows (minor, doc_id, at, signature, size or set) of each cell, in order."""
    cell, rows = None, []
    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in range(8)]
        for band, i, j, *row in zip(*cols, strict=True):
            if (band, i, j) != cell:
                if rows:
                    yield cell, rows
                cell, rows = (band, i, j), []
            rows.append(tuple(row))
    if rows:
        yield cell, rows


def _left_open(band: int, rows: list[tuple], sizes: np.ndarray):
    """For each minor member of block j its place, and the places of the members across components that sizes and signatures leave open, most alike first."""
    bounds, nth = prune_bounds(), int(band) & (PERMS // ROWS - 1)
    split = next((k for k, r in enumerate(rows) if r[0]), len(rows))
    if not 0 < split < len(rows):
        return
    ids = np.array([r[1] for r in rows], np.int64)
    root = np.array([r[2]["root"] for r in rows], np.int64)
    major = rows[0][2]["major"]
    sig = np.frombuffer(b"".join(r[3] for r in rows), np.uint32).reshape(len(rows), PERMS)
    for u in range(split, len(rows)):
        # of two minor members the larger id asks; pairs of another earlier band are asked there
        ask = (root[:split] != root[u]) & ((root[:split] == major) | (ids[:split] < ids[u]))
        ask &= 100 * np.minimum(sizes[:split], sizes[u]) >= NEED * np.maximum(sizes[:split], sizes[u])
        alive = np.flatnonzero(ask)
        same = np.zeros(len(alive), np.int64)
        for look, least in enumerate(bounds):
            cut = slice(look * BATCH, (look + 1) * BATCH)
            same = same + (sig[alive, cut] == sig[u, cut]).sum(axis=1)
            stay = same >= least
            alive, same = alive[stay], same[stay]
        if nth and len(alive):
            head = sig[alive, : nth * ROWS] == sig[u, : nth * ROWS]
            met = head.reshape(len(alive), nth, ROWS).all(axis=2).any(axis=1)
            alive, same = alive[~met], same[~met]
        if len(alive):
            yield u, alive[np.argsort(-same, kind="stable")]


def _cell_open(batches):
    """Cells with sizes of sets -> their members that have someone left to compare with."""
    for cell, rows in _cells(batches):
        kept = np.zeros(len(rows), bool)
        for u, others in _left_open(cell[0], rows, np.array([r[4] for r in rows], np.int64)):
            kept[u] = True
            kept[others] = True
        some = [rows[k] for k in np.flatnonzero(kept)]
        place = [pa.array([c] * len(some), pa.int64()) for c in cell]
        yield pa.RecordBatch.from_arrays([*place, pa.array([r[0] for r in some], pa.bool_()), pa.array([r[1] for r in some], pa.int64())], names=["band", "i", "j", "minor", "doc_id"])


def _cell_links(batches):
    """Cells with full sets -> links across components, one for each member and component at most."""
    for cell, rows in _cells(batches):
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        left, right = [], []
        for u, others in _left_open(cell[0], rows, np.array([len(s) for s in sets])):
            joined: set[int] = set()
            for v in others:
                if rows[v][2]["root"] not in joined and _linked_sets(sets[u], sets[v]):
                    joined.add(rows[v][2]["root"])
                    left.append(max(rows[u][1], rows[v][1]))
                    right.append(min(rows[u][1], rows[v][1]))
        yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in (left, right)], names=["a", "b"])


def _sets(batches):
    for batch in batches:
        sets: list[bytes] = []
        for _, counts, hashes in shingle_sets(batch.column(1)):
            ends = np.cumsum(counts)
            sets += [hashes[e - c : e].tobytes() for c, e in zip(counts, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "set"])


def _jaccard(batches):
    for batch in batches:
        pairs = zip(batch.column(2), batch.column(3), strict=True)
        linked = [_linked_sets(*(np.frombuffer(x.as_buffer(), np.uint64) for x in pair)) for pair in pairs]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, linked: the exact similarity of full shingle sets against the threshold."""
    pairs = written(pairs.select("a", "b"), "pairs")
    used = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "pair-ids")
    sets = written(texts.join(checked_broadcast(used), "doc_id").mapInArrow(_sets, "doc_id long, set binary"), "sets")
    met = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("xa")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("set").alias("xb")), "b"
    )
    return met.select("a", "b", "xa", "xb").mapInArrow(_jaccard, "a long, b long, linked boolean")

