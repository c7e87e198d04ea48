"""Benchmark decontamination as a prefix-filtered set join (DataFrame and SQL functions only).

A window is a run of `WINDOW` item words (a shorter item is one window). Its tokens are its shingles of
up to `SHINGLE` words. To contain a window whole, a document must have every token of it, so one token
is a sufficient prefix: the one that is rarest in the documents. One pass over the documents finds
where benchmark tokens stand; their counts order each window's tokens by rarity; occurrences of the
prefix token that leave room for the window on both sides (positional and length bounds) are
candidates; the words of the document there are then compared with the window's. Documents and windows go by
numbers of their own, so only tokens are hashes, and those are only a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, numbered, written

WINDOW, SHINGLE = 13, 3
#: A document is contaminated when 20 * hit words >= words.
SHARE = 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cases A-Z and takes the runs of digits, letters and non-ASCII characters; null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.length(text) == F.octet_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _token(array: str, at: Column, width: int) -> Column:
    cells = [F.get(F.col(array), at + F.lit(k)) for k in range(width)]
    return F.when(at + F.lit(width) <= F.size(array), F.xxhash64(F.lit(width), *cells))


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """item_id, win (the window's words), length."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    first = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1))))
    return (
        items.select("item_id", "w", first.alias("at"))
        .select("item_id", F.expr(f"slice(w, at, {window})").alias("win"))
        .withColumn("length", F.size("win"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", row_col: str | None = None) -> DataFrame:
    """One row for each input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts the words inside any occurrence of a window, n_items the items that have one;
    items_sha256 is of their ids, sorted as strings and joined by commas. Null and empty texts have
    no words and are clean. Null document ids are results of their own; rows that repeat an id are
    judged on their own text. Items without words have no window; a null item id counts for hits but not
    for n_items. An empty benchmark leaves all documents clean. row_col: a column that numbers the rows, if there is
    one. Other columns are ignored.
    """
    rows, at = (docs, row_col) if row_col else numbered(docs, id_col, text_col)
    texts = rows.select(F.col(id_col).alias("doc_id"), F.col(at).alias("key"), words(F.col(text_col)).alias("w"))
    windows = written(item_windows(benchmark, item_col, item_text), "windows")
    distinct = windows.select("win", "length").distinct().withColumn("wid", F.monotonically_increasing_id())
    distinct = written(distinct, "distinct-windows")
    widths = sorted(r[0] for r in distinct.select(F.least("length", F.lit(SHINGLE)).alias("k")).distinct().collect())

    tokens = None  # wid, length, off, token
    for k in widths:
        own = distinct.where((F.least("length", F.lit(SHINGLE))) == k).select(
            "wid", "win", "length", F.explode(F.sequence(F.lit(0), F.col("length") - k)).alias("off")
        )
        own = own.select("wid", "length", "off", _token("win", F.col("off"), k).alias("token"))
        tokens = own if tokens is None else tokens.unionByName(own)
    if tokens is None:
        return texts.select(
            "doc_id", F.size("w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated")
        )
    tokens = written(tokens, "window-tokens")
    known = written(tokens.select("token").distinct().withColumn("known", F.lit(True)), "known-tokens")

    at = F.col("pos")
    places = texts.select("doc_id", "key", "w", F.explode_outer(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1))).alias("pos"))
    found = [_token("w", at, k) for k in widths]
    if len(found) == 1:
        each = F.lit(0).alias("nth"), found[0].alias("token")
    else:
        each = (F.posexplode(F.array(*found)).alias("nth", "token"),)
    # the row at the first place stands for the document, matched or not
    head = (F.col("nth") == 0) & (F.coalesce(at, F.lit(0)) == 0)
    places = places.select("doc_id", "key", F.size("w").alias("n"), "pos", *each)
    seen = written(
        places.join(checked_broadcast(known), "token", "left")
        .where(F.col("known") | head)
        .select("doc_id", "key", "n", "pos", F.when(F.col("known"), F.col("token")).alias("token"), head.alias("head")),
        "token-places",
    )

    counts = seen.where("token is not null").groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    ranked = tokens.join(counts, "token")
    whole = tokens.groupBy("wid").agg(F.count(F.lit(1)).alias("all"))
    prefix = (
        ranked.groupBy("wid", "length")
        .agg(F.min(F.struct("freq", "token", "off")).alias("p"), F.count(F.lit(1)).alias("present"))
        .join(whole, "wid")
        .where("present = all")  # a token that no document has rules the window out
        .select("wid", "length", F.col("p.token").alias("token"), F.col("p.off").alias("off"))
    )
    prefix = written(prefix.join(distinct.select("wid", "win"), "wid"), "prefix-tokens")
    start = (F.col("pos") - F.col("off")).alias("start")
    candidates = written(
        seen.where("token is not null")
        .select("doc_id", "key", "n", "pos", "token")
        .join(checked_broadcast(prefix), "token")
        .select("doc_id", "key", "n", start, "length", "wid", "win")
        .where("start >= 0 and start + length <= n")
        .drop("n")
        .distinct(),
        "candidates",
    )
    open_ = checked_broadcast(written(candidates.select("key").distinct(), "candidate-docs"))
    bodies = texts.select("key", "w").join(open_, "key")
    hits = written(
        candidates.join(bodies, "key").where("slice(w, start + 1, length) = win").select("doc_id", "key", "start", "length", "wid"),
        "hits",
    )

    before = Window.partitionBy("key").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    covered = (
        hits.select("key", "start", "length")
        .distinct()
        .withColumn("done", F.coalesce(F.max(end).over(before), F.lit(0)))
        .groupBy("key")
        .agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "done"))).alias("n_hit"))
    )
    items = (
        hits.select("key", "wid")
        .distinct()
        .join(checked_broadcast(written(windows.join(distinct, "win").select("item_id", "wid").distinct(), "window-items")), "wid")
        .select("key", F.col("item_id").cast("string").alias("item"))
        .distinct()
        .groupBy("key")
        .agg(F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"), F.count("item").alias("n_items"))
    )
    zero = F.lit(0).cast("long")
    return (
        seen.where("head")
        .select("doc_id", "key", F.col("n").cast("long").alias("n_words"))
        .join(covered.join(items, "key", "left"), "key", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", zero).alias("n_hit"),
            F.coalesce("n_items", zero).alias("n_items"),
            F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        )
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))
    )
