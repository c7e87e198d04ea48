"""Removal of repeated passages over an enhanced suffix array, sampled and dealt out by content.

A passage of `LENGTH` bytes holds, at a place that its bytes alone decide, a least `GRAM`-byte gram: its
anchor. Equal passages have equal anchors, so suffixes that start at equal anchors are sorted together and no
task sees the whole corpus:

1. Equal texts are one document, that of the smallest id; of the others every byte goes.
2. Every text gives its anchors. Those whose gram occurs once hold no repeat and are dropped.
3. For each remaining gram its suffixes are sorted (a suffix array) with the lengths of their common
   prefixes; a stack scan gives the common-prefix intervals. Inside an interval the suffixes are
   sorted by what stands on their left, and a second scan tests where the left extensions divide.
   Interval and left class together are the maximal repeats, with all occurrences. The first
   occurrence (smallest document, then start) stays; every other one is covered.
4. A gram with more than `SPLIT` suffixes is cut into parts. Passages that are first in their part
   meet again by the digest of their bytes, at most one from each part.

For the removal, repeats are reported within `LENGTH` bytes to the right of the anchor and `LENGTH - GRAM` to its left;
longer ones are covered by the overlapping reports of their anchors. `repeat_groups` gives the maximal repeats
themselves, each with all its occurrences, from contexts of any reach. Long texts are handled in pieces of `PIECE` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bound_batches, checked_broadcast, numbered, settled, written
from .words import blocks, text_column

#: Bytes of a repeat that is removed; bytes of the gram that anchors it.
LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM
#: Suffixes of a gram that one task sorts together; suffixes gathered before a scan; bytes of a piece of a text.
SPLIT, GATHER, PIECE = 4096, 16384, 1 << 20
#: Keys over which a frequent gram is spread where such grams are too many to broadcast.
SALTS = 64
#: Different contexts of a gram beyond which they are dealt out by how far their repeats reach to the right of the anchor.
BANDED = 20_000

_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of all 32-byte grams, by doubling."""
    h = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
    step = 1
    for mix in _MIX:
        h = (h[:-step] * mix) ^ h[step:]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x2545F4914F6CDD1D)
        step *= 2
    return h ^ (h >> np.uint64(32))


def anchors_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors in concatenated texts (off: where the texts begin and end), and their hashes."""
    if len(raw) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = gram_hashes(raw)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))  # ties: the rightmost
    step, want = 1, REACH + 1
    while step * 2 <= want:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < want:
        least = np.minimum(least[: len(least) - (want - step)], least[want - step :])
    ends = np.repeat(off[1:], np.diff(off))[: len(least)]
    inside = np.arange(len(least)) + LENGTH <= ends
    at = (np.uint64(0xFFFFFFFF) - (least[inside] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    if len(at):
        fresh = np.ones(len(at), bool)
        fresh[1:] = at[1:] != at[:-1]
        at = at[fresh]
    return at, h[at]


def pieces(texts: DataFrame, before: int, after: int) -> DataFrame:
    """doc, piece, base, raw: texts (doc, text) in pieces of PIECE bytes, with so many bytes of the text before and after each; base is where raw begins."""
    raw = texts.select("doc", F.encode("text", "UTF-8").alias("raw"))
    each = raw.select("doc", "raw", F.explode(F.expr(f"sequence(0, int(greatest(octet_length(raw) - 1, 0) div {PIECE}))")).alias("piece"))
    base = F.expr(f"greatest(piece * {PIECE} - {before}, 0)").cast("int")
    end = F.expr(f"(piece + 1) * {PIECE} + {after}")
    return each.select("doc", "piece", base.alias("base"), F.substring("raw", base + 1, (end - base).cast("int")).alias("raw"))


def _anchors(batches):
    """doc, base, raw of pieces that begin one window early -> gram, doc, pos of their anchors."""
    for batch in batches:
        ids, bases = (batch.column(k).to_numpy() for k in (0, 1))
        for first, raw, off in blocks(batch.column(2)):
            at, h = anchors_of(raw, off)
            text = np.searchsorted(off, at, side="right") - 1
            fresh = np.ones(len(at), bool)
            fresh[1:] = text[1:] != text[:-1]
            own = ~(fresh & (bases[first + text] > 0))  # the anchor of the early window is the piece's before
            at, h, text = at[own], h[own], text[own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(ids[first + text]), pa.array((at - off[text] + bases[first + text]).astype(np.int32))], names=["gram", "doc", "pos"]
            )


def _contexts(left: int, right: int):
    """doc, base, raw, places (pos, gram, split, part) -> so many bytes on the left, reversed, and from each anchor on; part spreads the suffixes of a frequent gram."""

    def run(batches):
        for batch in batches:
            for doc, base, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                for k in range(0, len(places), 4096):
                    cut = places[k : k + 4096]
                    at = [p["pos"] - base for p in cut]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([p["gram"] for p in cut], pa.int64()),
                            pa.array([p["part"] for p in cut], pa.int64()),
                            pa.array([p["split"] for p in cut], pa.bool_()),
                            pa.array([doc] * len(cut), pa.int64()),
                            pa.array([p["pos"] for p in cut], pa.int32()),
                            pa.array([raw[max(0, p - left) : p][::-1] for p in at], pa.binary()),
                            pa.array([raw[p : p + right] for p in at], pa.binary()),
                        ],
                        names=["gram", "part", "split", "doc", "pos", "left", "right"],
                    )

    return lambda batches: _gathered(run(batches))


def _gathered(batches):
    """Rows of _contexts in small record batches come together in larger ones."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 8192:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def common_prefix(a: int, b: int, bits: int) -> int:
    """Common leading bytes of two numbers that hold bits / 8 bytes each."""
    return (bits - (a ^ b).bit_length()) >> 3


def intervals(lcp: list[int]) -> list[tuple[int, int, int]]:
    """Common-prefix intervals (depth, first, last) of a suffix array; lcp[i] is between suffixes i and i + 1. One stack scan."""
    found, stack = [], []
    for i, depth in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            found.append((top, first, i))
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
    return found


def losers(order: list[int], depth: list[int]) -> list[tuple[int, int]]:
    """(rank, depth) for all but the least rank: the deepest interval in which that rank is not the least.

    order: ranks of members sorted by left context; depth: common left bytes of neighbours. The scan
    keeps for each open interval its least rank; where two intervals join, the larger one loses.
    """
    lost, stack = [], [(-1, order[0])]
    for rank, d in zip(order[1:], depth, strict=True):
        while len(stack) > 1 and stack[-1][0] >= d:
            _close(stack, lost)
        stack.append((d, rank))
    while len(stack) > 1:
        _close(stack, lost)
    return lost


def _close(stack, lost):
    d, rank = stack.pop()
    below, other = stack[-1]
    lost.append((max(rank, other), d))
    stack[-1] = (below, min(rank, other))


def repeats(left: list[bytes], right: list[bytes]) -> list[tuple[int, int, int]]:
    """(member, left bytes, right bytes) of occurrences that are not the first of a maximal repeat of LENGTH bytes.

    Members are in order of occurrence; left contexts are reversed. Every member shares the gram.
    """
    out: list[tuple[int, int, int]] = []
    seen: dict[tuple[bytes, bytes], int] = {}
    for k, both in enumerate(zip(left, right, strict=True)):
        if both in seen:
            if len(both[0]) + len(both[1]) >= LENGTH:
                out.append((k, len(both[0]), len(both[1])))
        else:
            seen[both] = k
    own = list(seen.values())
    if len(own) < 2:
        return out
    rbits, lbits = 8 * LENGTH, 8 * REACH
    rnum = {k: int.from_bytes(right[k].ljust(LENGTH, b"\0"), "big") for k in own}
    lnum = {k: int.from_bytes(left[k].ljust(REACH, b"\0"), "big") for k in own}
    array = sorted(own, key=right.__getitem__)
    lcp = [min(common_prefix(rnum[a], rnum[b], rbits), len(right[a]), len(right[b])) for a, b in pairwise(array)]
    lefts = {k: n for n, k in enumerate(sorted(own, key=left.__getitem__))}
    for depth, first, last in intervals(lcp):
        if depth + REACH < LENGTH:
            continue
        members = sorted(array[first : last + 1], key=lefts.__getitem__)
        lcs = [min(common_prefix(lnum[a], lnum[b], lbits), len(left[a]), len(left[b])) for a, b in pairwise(members)]
        out += [(k, d, depth) for k, d in losers(members, lcs) if d + depth >= LENGTH]
    return out


def _removed(batches):
    """Contexts sorted by gram and part -> kind 0: covered bytes [start, end) of a document; kind 1: a passage first in its part."""

    def flush(rows):
        docs, starts, ends = [], [], []
        firsts: tuple[list, list, list] = ([], [], [])
        i = 0
        while i < len(rows):
            j = i + 1
            while j < len(rows) and rows[j][0] == rows[i][0]:
                j += 1
            if j - i > 1 or rows[i][1]:
                group = sorted(rows[i:j], key=lambda r: r[2:4])
                lost = repeats([r[4] for r in group], [r[5] for r in group])
                for k, d, depth in lost:
                    docs.append(group[k][2])
                    starts.append(group[k][3] - d)
                    ends.append(group[k][3] + depth)
                if rows[i][1]:
                    _first_passages(group, lost, firsts)
            i = j
        n, m = len(docs), len(firsts[0])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([None] * n + firsts[0], pa.binary()),
                pa.array(docs + firsts[1], pa.int64()),
                pa.array(starts + firsts[2], pa.int32()),
                pa.array(ends + [s + LENGTH for s in firsts[2]], pa.int32()),
            ],
            names=["passage", "doc", "start", "end"],
        ) if n + m else None

    rows: list = []
    for batch in batches:
        c = [batch.column(k).to_pylist() for k in range(7)]
        rows += zip(zip(c[0], c[1], strict=True), c[2], c[3], c[4], c[5], c[6], strict=True)
        if len(rows) >= GATHER and rows[0][0] != rows[-1][0]:
            cut = len(rows)
            while rows[cut - 1][0] == rows[-1][0]:
                cut -= 1
            if (done := flush(rows[:cut])) is not None:
                yield done
            rows = rows[cut:]
    if rows and (done := flush(rows)) is not None:
        yield done


def _first_passages(group, lost, firsts) -> None:
    covered: dict[int, set[int]] = {}
    for k, d, depth in lost:
        covered.setdefault(k, set()).update(range(LENGTH - depth, d + 1))
    for k, (_, _, doc, pos, left, right) in enumerate(group):
        whole = left[::-1] + right
        gone = covered.get(k, ())
        for o in range(max(0, LENGTH - len(right)), len(left) + 1):
            if o not in gone:
                at = len(left) - o
                firsts[0].append(hashlib.blake2b(whole[at : at + LENGTH], digest_size=16).digest())
                firsts[1].append(doc)
                firsts[2].append(pos - o)


def _kept(batches):
    """doc, text, removed runs -> bytes removed, their number, digest of what is left."""
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for text, cuts in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw = memoryview(text.as_buffer())
            left, n, done = hashlib.sha256(), 0, 0
            for start, end in sorted((c["start"], c["end"]) for c in cuts):
                left.update(raw[done:start])
                n += end - start
                done = end
            left.update(raw[done:])
            for column, value in zip(out, (n, len(cuts), left.hexdigest()), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["doc", "n_removed", "n_spans", "kept_sha256"]
        )


CONTEXT = "gram long, part long, split boolean, doc long, pos int, left binary, right binary"


def open_places(texts: DataFrame) -> DataFrame:
    """doc, piece, places (pos, gram, split, part): the anchors of `texts` whose gram occurs again.

    Grams with more than SPLIT anchors are spread over parts before anything is joined on them.
    """
    begun = pieces(texts, 1, LENGTH - 1).select("doc", "base", "raw")
    anchors = written(begun.mapInArrow(_anchors, "gram long, doc long, pos int"), "anchors")
    again = written(anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "grams")
    hot, cold = again.where(f"n > {SPLIT}"), again.where(f"n <= {SPLIT}")
    part = F.expr(f"pmod(xxhash64(doc, pos), 1 + n div {SPLIT})")
    if hot.isEmpty():
        met = anchors.join(cold, "gram").withColumn("part", F.lit(0).cast("long"))
    else:
        on = ["gram"]
        if hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            hot = F.broadcast(hot)
        else:
            on = ["gram", "salt"]
            hot = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            anchors = anchors.withColumn("salt", F.pmod(F.xxhash64("pos", "doc"), F.lit(SALTS)).cast("int"))
        seldom = anchors.join(hot, on, "left_anti").join(cold, "gram").withColumn("part", F.lit(0).cast("long"))
        met = anchors.join(hot, on).withColumn("part", part).select("gram", "doc", "pos", "n", "part").unionByName(seldom.select("gram", "doc", "pos", "n", "part"))
    place = F.struct("pos", "gram", F.expr(f"n > {SPLIT}").alias("split"), "part").alias("place")
    places = met.select("doc", F.expr(f"pos div {PIECE}").cast("int").alias("piece"), place)
    return places.groupBy("doc", "piece").agg(F.collect_list("place").alias("places"))  # of one piece of a text


def contexts(texts: DataFrame, left: int, right: int) -> DataFrame:
    """CONTEXT: the anchors of `texts` (doc, text; one row for each doc) whose gram occurs again, with the bytes around them."""
    places = settled(lambda: open_places(texts), "places")
    open_ = checked_broadcast(written(places.select("doc").distinct(), "open-docs"))
    around = pieces(texts.join(open_, "doc"), left, right).join(places, ["doc", "piece"]).select("doc", "base", "raw", "places")
    return around.mapInArrow(_contexts(left, right), CONTEXT)


def repeated_spans(texts: DataFrame) -> DataFrame:
    """doc, start, end: bytes of `texts` (doc, text; one row for each doc) in repeats whose first occurrence is elsewhere, as maximal runs."""
    found = contexts(texts, REACH, LENGTH).repartition("gram", "part").sortWithinPartitions("gram", "part")
    found = written(found.mapInArrow(_removed, "passage binary, doc long, start int, end int"), "repeats")
    first = F.min(F.struct("doc", "start")).over(Window.partitionBy("passage"))
    later = (
        found.where("passage is not null")
        .withColumn("first", first)
        .where(F.struct("doc", "start") != F.col("first"))
        .select("doc", "start", "end")
    )
    cuts = found.where("passage is null").select("doc", "start", "end").unionByName(later)
    in_order = Window.partitionBy("doc").orderBy("start", "end")
    reach = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opened = cuts.withColumn("opens", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    runs = opened.withColumn("run", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def maximal_repeats(left: list[bytes], right: list[bytes], copies: list[int], length: int, first: int, end: int) -> Iterator[tuple[int, int, list[int]]]:
    """(left bytes, right bytes, members) of the maximal repeats of at least `length` bytes that reach `first` to `end` - 1 bytes to the right of the anchor.

    Members are different contexts (left ones reversed) around one gram, each standing for so many copies. The
    common-prefix intervals of the suffix array give the right ends; within each, the intervals of the members sorted by
    what stands on their left give the left ends where extensions differ. A set that shares more on the right belongs
    to a deeper interval.
    """
    for k, (a, b, n) in enumerate(zip(left, right, copies, strict=True)):
        if n > 1 and len(a) + len(b) >= length and first <= len(b) < end:
            yield len(a), len(b), [k]
    if len(left) < 2:
        return
    wide = max(map(len, left)), max(map(len, right))
    lnum = [int.from_bytes(x.ljust(wide[0], b"\0"), "big") for x in left]
    rnum = [int.from_bytes(x.ljust(wide[1], b"\0"), "big") for x in right]
    array = sorted(range(len(right)), key=right.__getitem__)
    lcp = [min(common_prefix(rnum[a], rnum[b], 8 * wide[1]), len(right[a]), len(right[b])) for a, b in pairwise(array)]
    rank = {k: n for n, k in enumerate(array)}
    lefts = {k: n for n, k in enumerate(sorted(range(len(left)), key=left.__getitem__))}
    for depth, i, j in intervals(lcp):
        if not first <= depth < end or depth + wide[0] < length:
            continue
        members = sorted(array[i : j + 1], key=lefts.__getitem__)
        lcs = [min(common_prefix(lnum[a], lnum[b], 8 * wide[0]), len(left[a]), len(left[b])) for a, b in pairwise(members)]
        for d, x, y in intervals(lcs):
            if d + depth < length:
                continue
            own = members[x : y + 1]
            places = [rank[k] for k in own]
            if min(lcp[min(places) : max(places)]) == depth:
                yield d, depth, own


def _bands(length: int) -> list[tuple[int, int]]:
    """Ranges of how far repeats reach to the right of the anchor."""
    cuts = [*range(GRAM, length, 16), length, 1 << 30]
    return list(pairwise(cuts))


def _grouped(length: int):
    """key, first, end, left, right, copies, context, in order of key -> maximal repeats: digest, left and right bytes, context."""

    def found(rows):
        for d, depth, members in maximal_repeats([r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows], length, rows[0][1], rows[0][2]):
            whole = rows[members[0]]
            digest = hashlib.blake2b(whole[3][:d][::-1] + whole[4][:depth], digest_size=16).digest()
            for k in members:
                yield digest, d, depth, rows[k][6]

    def out(made):
        columns = list(zip(*made, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["repeat", "l", "r", "context"])

    def run(batches):
        rows, made = [], []
        for row in (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            if rows and rows[0][0] != row[0]:
                made += found(rows)
                rows = []
                if len(made) > GATHER:
                    yield out(made)
                    made = []
            rows.append(row)
        made += found(rows) if rows else []
        if made:
            yield out(made)

    return run


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 1024) -> DataFrame:
    """Maximal repeats with all their occurrences: repeat (digest of its bytes), n_bytes, clipped, doc_id, start.

    A maximal repeat is a string of at least LENGTH bytes that stands at two places or more, not all of them with the same
    byte before, nor with the same byte after (a text's end is like no byte). Exact for repeats of up to `reach` bytes; of longer ones
    there are the pieces within `reach` bytes of each anchor, marked clipped. Null texts are empty; every row is a
    document of its own, also where ids are null or repeat. Equal contexts, so all copies of a passage, are one member in the
    scan and are joined back to their occurrences, whatever their number; a gram with more than BANDED different contexts is
    dealt out by how far its repeats reach. Other columns are ignored; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    rows, at = numbered(docs, id_col, text_col)
    rows = rows.select(F.col(at).alias("doc"), F.col(id_col).alias("doc_id"), text_column(F.col(text_col)).alias("text"))
    around = contexts(rows.where(F.octet_length("text") >= LENGTH).select("doc", "text"), reach, reach)
    key = F.unhex(F.sha2(F.concat(F.length("left").cast("string").cast("binary"), F.lit(b" "), "left", "right"), 256))
    around = written(around.select("gram", "doc", "pos", key.alias("context"), "left", "right"), "contexts")
    each = around.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("copies"), F.first("left").alias("left"), F.first("right").alias("right"))
    each = written(each, "different-contexts")
    many = checked_broadcast(written(each.groupBy("gram").count().where(f"count > {BANDED}").select("gram", F.lit(True).alias("many")), "wide-grams"))
    each = each.join(many, "gram", "left")
    few = each.where("many is null").select(F.col("gram").cast("string").cast("binary").alias("key"), F.lit(0).alias("first"), F.lit(1 << 30).alias("end"), "left", "right", "copies", "context")
    for first, end in _bands(LENGTH):
        shared = max(0, LENGTH - end + 1)  # a repeat of this band has so many bytes on the left, and `first` on the right
        here = each.where(F.col("many") & (F.length("right") >= first) & (F.length("left") >= shared))
        own = F.concat(F.lit(f"{first} ".encode()), F.substring("left", 1, shared), F.substring("right", 1, first))
        few = few.unionByName(here.select(F.unhex(F.sha2(own, 256)).alias("key"), F.lit(first).alias("first"), F.lit(end).alias("end"), "left", "right", "copies", "context"))
    groups = few.repartition("key").sortWithinPartitions("key").mapInArrow(_grouped(LENGTH), "repeat binary, l int, r int, context binary")
    found = written(groups, "repeat-groups").join(around.select("context", "doc", "pos"), "context")
    clipped = (F.col("l") == reach) | (F.col("r") == reach)
    found = found.select("repeat", (F.col("l") + F.col("r")).alias("n_bytes"), clipped.alias("clipped"), "doc", (F.col("pos") - F.col("l")).alias("start"))
    found = found.groupBy("repeat", "n_bytes", "doc", "start").agg(F.bool_and("clipped").alias("clipped"))
    return found.join(rows.select("doc", "doc_id"), "doc").select(F.lower(F.hex("repeat")).alias("repeat"), "n_bytes", "clipped", "doc_id", "start")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are their UTF-8 bytes; a null text is empty. Every byte goes that a 100-byte string covers which
    also starts earlier: in a document with a smaller id, or earlier in the same one. Judged on the
    input. Rows with equal id and text are one document. Rows with equal ids but different texts
    count in the order of their texts' SHA-256; null ids come last. Texts under 100 bytes lose
    nothing. Other columns are ignored; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(F.col(text_col)).alias("text"))
    rows = rows.select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("sha"))
    base = written(rows.select("doc_id", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "texts")
    classes = base.groupBy("sha").agg(F.min("doc_id").alias("rep"), F.max("n_bytes").alias("n_bytes"))
    classes = written(classes.where(f"n_bytes >= {LENGTH}"), "text-classes")
    clash = classes.groupBy("rep").count().where("count > 1")
    if classes.where("rep is null").isEmpty() and clash.isEmpty():
        classes = classes.withColumn("doc", F.col("rep"))
    else:  # ids that repeat or are null: number the classes in order
        ranked = classes.orderBy(F.col("rep").asc_nulls_last(), "sha").withColumn("doc", F.monotonically_increasing_id())
        classes = written(ranked, "numbered-classes")
    texts = _one_of_each(rows, base, classes)
    cut = repeated_spans(texts).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    cut = written(cut, "cuts")
    kept = (
        texts.join(checked_broadcast(cut.select("doc")), "doc")
        .join(cut, "doc")
        .select("doc", "text", "cuts")
        .mapInArrow(_kept, "doc long, n_removed long, n_spans long, kept_sha256 string")
    )
    shown = classes.select("sha", "rep", "doc").join(kept, "doc", "left").drop("doc")
    later = (F.col("n_bytes") >= LENGTH) & ~F.col("doc_id").eqNullSafe(F.col("rep"))
    zero = F.lit(0).cast("long")
    return base.join(shown, "sha", "left").select(
        "doc_id",
        "n_bytes",
        F.when(later, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(later, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(later, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def _one_of_each(rows: DataFrame, base: DataFrame, classes: DataFrame) -> DataFrame:
    """doc, text: one row for each class, without moving texts where the other rows are few."""
    extra = written(
        base.join(classes.select("sha", "rep"), "sha").where(~F.col("doc_id").eqNullSafe(F.col("rep"))).select("sha", "doc_id").distinct(), "later-copies"
    )
    plain = "doc" in classes.columns and classes.where("doc <> rep or rep is null").isEmpty()
    same = base.groupBy("doc_id").count().where("count > 1").isEmpty()
    texts = rows.where(F.octet_length("text") >= LENGTH)
    if plain and same:
        texts = texts.join(checked_broadcast(extra.select("doc_id")), "doc_id", "left_anti")
        return texts.select(F.col("doc_id").alias("doc"), "text")
    return (
        texts.join(classes.select("sha", "rep", "doc"), "sha")
        .where(F.col("doc_id").eqNullSafe(F.col("rep")))
        .dropDuplicates(["sha"])
        .select("doc", "text")
    )
