"""Browsing a catalog: facets, artist groups, letters, popularity, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.sources.shared import kept

PAGE = 24
LETTERS = [*(chr(65 + k) for k in range(26)), "#"]

#: Language tags in titles, in order of precedence, with the names that facets show.
LANGUAGE_TAGS = [
    ("(?i)粤语|粵語|廣東話|广东话|cantonese", "粤语"),
    ("(?i)国语|國語|普通话|普通話|华语|華語|mandarin", "国语"),
    ("(?i)日语|日語|japanese|j-?pop", "日语"),
    ("(?i)韩语|韓語|korean|k-?pop", "韩语"),
    ("(?i)闽南|閩南|台语|台語|hokkien", "闽南语"),
]
HAN = r"[\x{4e00}-\x{9fff}]"


def language_bucket(title: Column) -> Column:
    """By tag, else by script: no Han but Latin letters is English, any Han is Mandarin."""
    text = F.coalesce(title, F.lit(""))
    first, *rest = LANGUAGE_TAGS
    case = F.when(text.rlike(first[0]), first[1])
    for pattern, name in rest:
        case = case.when(text.rlike(pattern), name)
    return case.when(text.rlike(HAN), "国语").when(text.rlike("[a-zA-Z]"), "英语").otherwise("其他")


def song_info(songs: DataFrame) -> DataFrame:
    """Shown title and artist, language, number of Han characters, and the letters of song and artist by the search index."""
    title = F.coalesce(F.expr("nullif(track, '')") if "track" in songs.columns else F.lit(None).cast("string"), F.expr("nullif(title, '')"), F.lit("未命名"))
    return songs.withColumns({
        "shown_title": title,
        "shown_artist": F.coalesce("artist", F.lit("")),
        "lang": language_bucket(F.col("title")),
        "chars": F.regexp_count(title, F.lit(HAN)),
        "letter": letter(F.col("index").getItem(0)),
        "artist_letter": letter(F.col("index").getItem(1)),
    })


def letter(field: Column) -> Column:
    """A-Z by how an index field is read, full sounds before its folded text; # for all else."""
    sound = F.coalesce(F.nullif(F.try_element_at(field["phonetics"], F.lit(1)), F.lit("")), field["text"])
    first = F.upper(F.left(sound, F.lit(1)))
    return F.when(first.rlike("^[A-Z]$"), first).otherwise(F.lit("#"))


def without_lyrics(songs: DataFrame) -> DataFrame:
    """No lyrics by status, or a line count that is not above zero; an unknown count is none."""
    status = F.coalesce(F.col("lyrics_status"), F.lit("")) == "none" if "lyrics_status" in songs.columns else F.lit(False)
    return songs.where(status | (F.coalesce("line_count", F.lit(0)) <= 0))


def facet(rows: DataFrame, column: str) -> DataFrame:
    """Counts by value, largest first; equal counts by value."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column)


def letter_facet(rows: DataFrame, column: str = "letter") -> DataFrame:
    """All 27 letters with their counts, empty ones too, and the total."""
    every = F.explode(F.array(*(F.lit(x) for x in LETTERS)))
    letters = rows.sparkSession.range(1).select(every.alias(column))
    n = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return letters.join(n, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))


def artist_groups(rows: DataFrame, key: str, spelling: str, position: str) -> DataFrame:
    """Size of each group and its commonest spelling; of equally common ones that seen first."""
    each = rows.groupBy(key, spelling).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("seen"))
    return each.groupBy(key).agg(F.sum("n").alias("size"), F.max_by(spelling, F.struct("n", -F.col("seen"))).alias("label"))


def popular(songs: DataFrame, ranked: DataFrame) -> DataFrame:
    """Songs of a ranking, in its order."""
    return songs.join(ranked, "job_id").orderBy(F.col("plays").desc(), F.col("last_played_at").desc(), "job_id")


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """Global row numbers in an order without one task for all rows: range partitions, their sizes, an offset for each.

    The partitions are kept, as their bounds come from a sample that another reading may draw differently.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *order).withColumn("_p", F.spark_partition_id())
    ranged = kept(ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(*order))))
    sizes = ranged.groupBy("_p").agg(F.max("_k").alias("_size"))  # one row for each partition
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_p", before.alias("_before"))
    return ranged.join(F.broadcast(offsets), "_p").withColumn("row", F.col("_before") + F.col("_k")).drop("_p", "_k", "_before")


def offset_page(rows: DataFrame, order: list, requested: int, size: int = PAGE) -> DataFrame:
    """One page of an order with the numbers of the page and of pages; the request is held within 1 and the last."""
    pages = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(float(size)))).cast("long")
    facts = rows.agg(pages.alias("pages")).withColumn("page", F.greatest(F.lit(1), F.least(F.lit(requested), "pages")).cast("long"))
    page, pages_n = (int(x) for x in facts.select("page", "pages").first())
    return rows.orderBy(*order).offset(size * (page - 1)).limit(size).withColumn("page", F.lit(page)).withColumn("pages", F.lit(pages_n))
