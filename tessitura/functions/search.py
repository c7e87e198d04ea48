"""Search scores of indexed songs, and the ordered search over a catalog.

An index is an array of three structs (text, phonetics, initials): shown title, artist, original title.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.sources.shared import bounded

from .text import normalize, parse_query

#: Scores of an exact hit in each field; what a prefix and an inner hit lose; phonetic and initial hits; title with artist.
EXACT = (120, 115, 105)
PREFIX_LOSS, INNER_LOSS = 40, 60
PHONETIC, INITIAL = (35, 30, 25), (20, 15)
TOGETHER, URL_HIT = 100, 10

INDEX_TYPE = "array<struct<text:string,phonetics:array<string>,initials:array<string>>>"


def literal_index(title: Column, track: Column, artist: Column, table: Mapping[str, str] | None = None) -> Column:
    """An index without phonetics."""
    none = F.array().cast("array<string>")
    shown = F.coalesce(F.nullif(track, F.lit("")), title)
    fields = [F.struct(normalize(c, table).alias("text"), none.alias("phonetics"), none.alias("initials")) for c in (shown, artist, title)]
    return F.array(*fields)


def term_score(index: Column, term: Column) -> Column:
    """The best of all fields' hits of one term, -1 without any."""

    def hits(text: Column, whole, prefix, inner=None) -> Column:
        found = text.startswith(term) if inner is None else text.contains(term)
        some = F.when((text == "") | ~found, -1).when(text == term, whole)
        return some.otherwise(prefix) if inner is None else some.when(text.startswith(term), prefix).otherwise(inner)

    def of(field: Column, k: Column) -> Column:
        exact = F.element_at(F.array(*map(F.lit, EXACT)), k + 1)
        sounds = F.array_max(F.transform(field["phonetics"], lambda p: hits(p, *PHONETIC)))
        return F.greatest(hits(field["text"], exact, exact - PREFIX_LOSS, exact - INNER_LOSS), sounds, F.array_max(F.transform(field["initials"], lambda p: hits(p, *INITIAL))))

    return F.greatest(F.array_max(F.transform(index, of)), F.lit(-1))


def query_score(index: Column, needle: Column) -> Column:
    """Relevance of a song for a parsed query, a struct (text, terms), below zero without a hit, 0 for an empty query.

    The best of the whole query as one term, of title and artist together, and of the mean over the
    terms if each has a hit.
    """
    text, terms = needle.getField("text"), needle.getField("terms")
    title, artist = index.getItem(0).getField("text"), index.getItem(1).getField("text")
    joined = (title != "") & (artist != "") & ((F.concat(title, artist) == text) | (F.concat(artist, title) == text))

    def best(scores: Column) -> Column:
        """Of the scores of the whole query, then of each term."""
        each = F.slice(scores, F.lit(2), F.size(terms))
        mean = F.when(F.forall(each, lambda x: x >= 0), F.aggregate(each, F.lit(0), lambda a, x: a + x) / F.size(terms))
        return F.greatest(F.get(scores, F.lit(0)).cast("double"), F.when(joined, F.lit(float(TOGETHER))), mean)

    scores = F.transform(F.concat(F.array(text), terms), lambda t: term_score(index, t))
    return F.when(text == "", F.lit(0.0)).otherwise(F.get(F.transform(F.array(scores), best), F.lit(0)))


def search(songs: DataFrame, query: str, table: Mapping[str, str] | None = None, most: int | None = None) -> DataFrame:
    """Songs with an `index` column that a query finds, best first, at most `most`; ties by the names' sound, then text, then id.

    A URL that holds the query scores 10 if nothing scores more. A song is scored only if each term, or the whole query,
    stands somewhere in its index, which one look at all its texts together decides.
    """
    text, terms = parse_query(query, table)
    needle = F.struct(F.lit(text).alias("text"), F.array(*map(F.lit, terms)).cast("array<string>").alias("terms"))
    rows = bounded(songs).withColumn("_all", F.array_join(F.flatten(F.transform("index", lambda f: F.concat(F.array(f["text"]), f["phonetics"], f["initials"]))), "\n"))
    near = F.col("_all").contains(text)
    if terms:
        near |= reduce(lambda a, b: a & b, (F.col("_all").contains(t) for t in terms))
    title, artist = F.col("index").getItem(0)["text"], F.col("index").getItem(1)["text"]
    near |= (F.length(title) + F.length(artist) == len(text)) & (F.concat(title, artist).isin(text) | F.concat(artist, title).isin(text))
    rows = rows.withColumn("relevance", F.when(near, query_score(F.col("index"), needle)).otherwise(F.lit(-1.0))).drop("_all")
    if "url" in songs.columns and query.strip():
        in_url = (needle.getField("text") != "") & F.lower(F.coalesce("url", F.lit(""))).contains(query.strip().casefold())
        rows = rows.withColumn("relevance", F.when(in_url, F.greatest("relevance", F.lit(float(URL_HIT)))).otherwise(F.col("relevance")))

    def names(k: int) -> list[Column]:
        field = F.col("index").getItem(k)
        return [F.coalesce(F.try_element_at(field.getField("phonetics"), F.lit(1)), field.getField("text")), field.getField("text")]

    found = rows.where("relevance >= 0").orderBy(F.col("relevance").desc(), *names(0), *names(1), F.col("id").cast("string"))
    return found if most is None else found.limit(most)
