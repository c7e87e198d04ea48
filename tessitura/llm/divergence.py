"""How the sources of each language differ in their terms, and by which terms each stands out.

Terms are counted per worker before anything is shuffled. A share of a term that a group lacks is the group's
baseline, the same for all such terms, so distances between two sources are taken from the terms that at least one
of them has: the baselines' distance for all terms, plus corrections. The terms that a group shows most are found by radix
selection: histograms over the bits of the values narrow down each group's threshold, and rows equal to it are
told apart by histograms over their bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, checked_broadcast, written
from .words import text_column

#: Shares are whole billionths.
UNIT = 1_000_000_000
#: Added to each count.
PRIOR = 5
#: Bits of a value, UNIT at most, and bits of one histogram.
VALUE_BITS, STEP_BITS = 30, 10
#: Counters of a worker go out beyond so many entries, or bytes of text since the last time.
KEEP_ENTRIES, KEEP_BYTES = 400_000, 64 << 20
#: Bytes of a text that are split into terms at once, and rows of a batch that goes out.
PIECE, OUT_ROWS = 1 << 20, 20_000

_BLANK = b" "
#: letters and all bytes of longer characters stay, A-Z lower-cased; the other ASCII characters end a term
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTED = "lang string, source string, term string, n long, docs long"


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A text's bytes with blanks between terms, in pieces that end there."""
    if len(raw) <= PIECE:
        yield raw
        return
    at = 0
    while at < len(raw):
        end = raw.find(_BLANK, at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end]
        at = end


def _term_counts(batches):
    """lang, source, text -> for each group and term the occurrences and documents since the last output; a row with a null term for each group."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    entries = read = 0

    def out():
        for (lang, source), (n, docs) in groups.items():
            terms = [None, *n]
            counts, holders = [0, *n.values()], [0, *map(docs.__getitem__, n)]
            for at in range(0, len(terms), OUT_ROWS):
                cut = slice(at, at + OUT_ROWS)
                size = len(terms[cut])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * size), pa.array([source] * size), pa.array(terms[cut], pa.binary()).cast(pa.string()), pa.array(counts[cut], pa.int64()), pa.array(holders[cut], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            raw = text.as_buffer().to_pybytes().translate(_TERM_BYTES)
            own: set[bytes] = set()
            for piece in _pieces(raw):
                words = piece.split()
                n.update(words)
                own.update(words)
            docs.update(own)
            entries += len(n) - before
            read += len(raw)
            if entries > KEEP_ENTRIES or read > KEEP_BYTES:
                yield from out()
                groups.clear()
                entries = read = 0
    yield from out()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term); each group has a row with a null term too."""
    bound_batches(docs.sparkSession)
    rows = docs.select(text_column(F.col(lang_col)).alias("lang"), text_column(F.col(source_col)).alias("source"), text_column(F.col(text_col)).alias("text"))
    return rows.mapInArrow(_term_counts, _COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * terms)), exactly; null where there are no terms."""
    whole = [F.col(c) if isinstance(c, str) else c for c in (count, total, terms)]
    return F.when(whole[2] > 0, _quotient(F.lit(UNIT).cast("decimal(10,0)") * (whole[0] + PRIOR).cast("decimal(20,0)"), (whole[1] + PRIOR * whole[2]).cast("decimal(20,0)")) + 1)


def _quotient(a: Column, b: Column) -> Column:
    """The whole part of a / b as a long: decimals are divided without rounding."""
    return F.call_function("div", a, b)


def radix_top(rows: DataFrame, keys: list[str], value: str, item: str, k: int) -> DataFrame:
    """The k rows of each group with the largest value, ties by the smaller item in UTF-8 bytes.

    rows: a written table. Values: whole numbers from 0 below 2**VALUE_BITS. Items of a group differ. Groups with fewer
    rows keep all. No task sees more of a group than a histogram: its threshold is found bit field by bit field.
    """
    limits = None  # keys, prefix: the high bits of the threshold; need: rows still to be found at or below it
    for shift in range(VALUE_BITS - STEP_BITS, -1, -STEP_BITS):
        bucket = F.shiftright(F.col(value), shift)
        live = rows if limits is None else rows.join(limits, keys).where(F.shiftright(F.col(value), shift + STEP_BITS) == F.col("prefix"))
        need = F.lit(k).cast("long") if limits is None else F.first("need")
        hist = live.groupBy(*keys, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("c"), need.alias("need"))
        limits = checked_broadcast(written(_crossed(hist, keys, F.desc("bucket")).select(*keys, F.col("bucket").alias("prefix"), F.col("rest").alias("need"), "c"), "limits"))
    found = rows.join(limits, keys)
    sure = found.where((F.col(value) > F.col("prefix")) | (F.col(value) == F.col("prefix")) & (F.col("c") <= F.col("need")))
    open_ = limits.where("c > need").drop("prefix", "c")
    if open_.isEmpty():
        return sure.select(*rows.columns)
    ties = written(found.where((F.col(value) == F.col("prefix")) & (F.col("c") > F.col("need"))).select(*rows.columns), "ties")
    return sure.select(*rows.columns).unionByName(_first_items(ties, keys, item, open_))


def _crossed(hist: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Of each group's histogram (bucket, c, need) the bucket that holds the last row needed; rest: rows needed of it."""
    so_far = Window.partitionBy(*keys).orderBy(order)
    total = Window.partitionBy(*keys)
    summed = hist.withColumn("upto", F.sum("c").over(so_far)).withColumn("all", F.sum("c").over(total))
    hit = (F.col("upto") >= F.least("need", "all")) & (F.col("upto") - F.col("c") < F.least("need", "all"))
    return summed.where(hit).withColumn("rest", F.col("need") - F.col("upto") + F.col("c"))


def _first_items(ties: DataFrame, keys: list[str], item: str, limits: DataFrame) -> DataFrame:
    """Of each group's ties the `need` smallest items: histograms over two bytes after what all of them begin with."""
    columns, raw = ties.columns, F.encode(F.col(item), "UTF-8")
    out = None
    limits = limits.select(*keys, "need")
    while True:
        ends = ties.groupBy(*keys).agg(F.encode(F.min(item), "UTF-8").alias("low"), F.encode(F.max(item), "UTF-8").alias("high"))
        # the smallest and the largest share no more than all do
        both = F.sequence(F.lit(1), F.greatest(F.least(F.length("low"), F.length("high")), F.lit(1)))
        differ = F.array_position(F.transform(both, lambda i: F.substring("low", i, 1) == F.substring("high", i, 1)), False)
        at = F.when(differ > 0, differ).otherwise(F.least(F.length("low"), F.length("high")) + 1).cast("int")
        starts = checked_broadcast(written(ends.select(*keys, at.alias("at")).join(limits, keys), "starts"))
        placed = ties.join(starts, keys).withColumn("bucket", _byte_at(raw, F.col("at")) * 257 + _byte_at(raw, F.col("at") + 1))
        hist = placed.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("c"), F.first("need").alias("need"))
        cut = _crossed(hist, keys, F.asc("bucket")).select(*keys, F.col("bucket").alias("edge"), "rest", F.col("c").alias("edge_c"))
        cut = checked_broadcast(written(cut, "cut"))
        met = placed.join(cut, keys)
        taken = met.where("bucket < edge OR (bucket = edge AND edge_c <= rest)").select(*columns)
        out = taken if out is None else out.unionByName(taken)
        limits = cut.where("edge_c > rest").select(*keys, F.col("rest").alias("need"))
        if limits.isEmpty():
            return out
        ties = written(met.where("bucket = edge AND edge_c > rest").select(*columns), "ties")


def _byte_at(raw: Column, at: Column) -> Column:
    """1 + the byte at a place (from 1), 0 after the end."""
    return F.when(at <= F.length(raw), F.conv(F.hex(F.substring(raw, at, F.lit(1))), 16, 10).cast("int") + 1).otherwise(0)


def _distances(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: for each two sources of a language the sum over all terms of the differences of their shares.

    cells: lang, source, term, p. groups: lang, source, base (share of a term that it lacks), terms. With a, b the shares and
    x, y the baselines of two sources, |a-b| summed over all terms is: |x-y| for every term; |a-y|-|x-y| for each that the first
    has, the like for the second; and |a-b|-|a-y|-|x-b|+|x-y| for those of both.
    """
    one, two = groups.select("lang", F.col("source").alias("s"), F.col("base").alias("x"), "terms"), groups.select("lang", F.col("source").alias("t"), F.col("base").alias("y"))
    pairs = one.join(two, "lang").where("s <> t")
    # shares of terms that are there are no less than the baseline: only those below the other's need a look
    own = cells.groupBy("lang", F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("k"), F.sum("p").alias("sum_p"))
    hist = cells.groupBy("lang", F.col("source").alias("s"), "p").agg(F.count(F.lit(1)).alias("k"))
    above = pairs.where("x < y").select("lang", "s", "t", "y")
    low = above.join(hist, ["lang", "s"]).where("p < y").groupBy("lang", "s", "t").agg(F.sum(2 * F.col("k") * (F.col("y") - F.col("p"))).alias("low"))
    left, right = cells.select("lang", "term", F.col("source").alias("s"), F.col("p").alias("a"), F.col("base").alias("x")), cells.select("lang", "term", F.col("source").alias("t"), F.col("p").alias("b"), F.col("base").alias("y"))
    both = left.join(right, ["lang", "term"]).where("s < t").groupBy("lang", "s", "t").agg(F.sum(F.expr("abs(a - b) - abs(a - y) - abs(x - b) + abs(x - y)")).alias("both"))
    both = written(both, "shared-terms")
    both = both.unionByName(both.select("lang", F.col("t").alias("s"), F.col("s").alias("t"), "both"))
    side = pairs.join(own, ["lang", "s"], "left").join(low, ["lang", "s", "t"], "left")
    gap = F.abs(F.col("x") - F.col("y"))
    half = F.coalesce(F.col("sum_p") - F.col("k") * F.col("y") - F.col("k") * gap, F.lit(0)) + F.coalesce("low", F.lit(0))
    side = written(side.select("lang", "s", "t", (F.coalesce(F.col("terms") * gap, F.lit(0))).alias("gap"), half.alias("half")), "sides")
    other = side.select("lang", F.col("s").alias("t"), F.col("t").alias("s"), F.col("half").alias("other"))
    return side.join(other, ["lang", "s", "t"]).join(both, ["lang", "s", "t"], "left").select(
        "lang", F.col("s").alias("source"), F.col("t").alias("item"), (F.col("gap") + F.col("half") + F.col("other") + F.coalesce("both", F.lit(0))).alias("value")
    )


def source_divergence(docs: DataFrame, least_docs: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank: how far each source is from the others of its language, and its foremost terms.

    Terms are runs of letters A-Z, a-z and characters beyond ASCII, A-Z lower-cased. A language keeps the terms that `least_docs` of its
    documents have. Part `pair` has every other source of the language with the summed differences of the shares of all kept
    terms; part `term` the `top` kept terms that the source has and whose share is above the language's, by that excess. Ranks
    go by value, then by the UTF-8 bytes of the item.

    Null text, language or source count as empty; a group whose documents have no terms takes part with counts of zero; a language
    without kept terms has distances of 0 and no terms. Repeated rows count each time. Texts of any length are read whole.
    Other columns are ignored; an empty table gives an empty result. Counts up to 9e15 a group are exact.
    """
    counts = written(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    by_term = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("d"))
    kept = written(by_term.where(F.col("d") >= least_docs).select("lang", "term", "lang_n"), "kept-terms")
    cells = written(counts.where("term IS NOT NULL").drop("docs").join(checked_broadcast(kept), ["lang", "term"]), "cells")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.select("lang", "source", F.coalesce("terms", F.lit(0)).alias("terms"), "lang_total", F.coalesce("total", F.lit(0)).alias("total"))
    groups = written(groups.withColumn("base", share(F.lit(0), "total", "terms")), "groups")
    shares = cells.join(checked_broadcast(groups), ["lang", "source"]).select(
        "lang", "source", "term", "base", share("n", "total", "terms").alias("p"), share("lang_n", "lang_total", "terms").alias("q")
    )
    shares = written(shares, "shares")
    above = written(shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), "above")
    foremost = radix_top(above, ["lang", "source"], "value", "item", top)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    parts = [(_distances(shares.select("lang", "source", "term", "base", "p"), groups), "pair"), (foremost, "term")]
    ranked = [rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.row_number().over(order).alias("rank")) for rows, part in parts]
    return ranked[0].unionByName(ranked[1])
