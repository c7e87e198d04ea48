"""Han to Latin sounds for search indices.

The base map comes from the ICU library that ships with Spark, character by character, read on the driver for
the characters that a catalog holds; `PHRASES` sets readings that depend on their neighbours, so its coverage of
such phrases is partial.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.sources.shared import bounded

from .text import SEARCH_HAN, words

#: Phrases (simplified) whose characters are read otherwise than alone.
PHRASES = {
    "重庆": ["chong", "qing"],
    "音乐": ["yin", "yue"],
    "乐队": ["yue", "dui"],
    "快乐": ["kuai", "le"],
    "长大": ["zhang", "da"],
    "银行": ["yin", "hang"],
    "觉得": ["jue", "de"],
    "睡觉": ["shui", "jiao"],
    "还是": ["hai", "shi"],
    "重新": ["chong", "xin"],
}


def _transliterator(spark: SparkSession, ident: str):
    return spark._jvm.com.ibm.icu.text.Transliterator.getInstance(ident)


def simplified(spark: SparkSession, characters: Iterable[str]) -> dict[str, str]:
    """Single characters that have another simplified form."""
    convert = _transliterator(spark, "Traditional-Simplified")
    pairs = ((c, convert.transliterate(c)) for c in sorted(set(characters)))
    return {a: b for a, b in pairs if a != b and len(b) == 1}


def readings(spark: SparkSession, characters: Iterable[str]) -> dict[str, str]:
    """Sound of each character in ASCII letters, with v for the u that has two dots."""
    convert = _transliterator(spark, "Han-Latin")
    out = {}
    for c in sorted(set(characters)):
        sound = unicodedata.normalize("NFD", convert.transliterate(c)).replace("ü", "v")
        out[c] = "".join(x for x in sound if x.isascii() and x.isalpha()).lower()
    return out


def han_characters(rows: DataFrame, columns: list[str]) -> list[str]:
    """Distinct Han characters of some columns; bounded by the script's size."""
    texts = [F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(f"({SEARCH_HAN})"), 1) for c in columns]
    return [r[0] for r in rows.select(F.explode(F.array_distinct(F.flatten(F.array(*texts))))).distinct().collect()]


def field(text: str, sounds: dict[str, str], phrases: dict[str, list[str]]) -> dict:
    """Index field of a folded text: itself, its full sounds and initials, also of its Han characters alone."""
    if not any(c in sounds for c in text):
        return {"text": text.replace(" ", ""), "phonetics": [], "initials": []}
    longest = max(map(len, phrases), default=0)
    parts, han, i = [], [], 0
    while i < len(text):
        for n in range(min(longest, len(text) - i), 1, -1):
            if text[i : i + n] in phrases:
                read = phrases[text[i : i + n]]
                break
        else:
            n, read = 1, [sounds.get(text[i], text[i])]
        for c, sound in zip(text[i : i + n], read, strict=True):
            parts.append(sound)
            if c in sounds:
                han.append(sound)
        i += n
    full = "".join(p for p in parts).replace(" ", "")
    # the dotted u folds to u in one form and stays v in the other
    both = "".join(p.replace("v", "u") if p in set(han) else p for p in parts).replace(" ", "")
    alone = "".join(han)
    first = "".join(p[:1] for p in parts).replace(" ", "")
    return {
        "text": text.replace(" ", ""),
        "phonetics": list(dict.fromkeys([both, full, alone.replace("v", "u"), alone])),
        "initials": list(dict.fromkeys([first, "".join(p[:1] for p in han)])),
    }


def phonetic_field(value: Column, table: dict[str, str], sounds: dict[str, str], phrases: dict[str, list[str]] | None = None) -> Column:
    """Struct (text, phonetics, initials) of a column. Only texts with Han characters go to Python, distinct values of a batch once."""
    phrases = PHRASES if phrases is None else phrases

    @F.pandas_udf("text string, phonetics array<string>, initials array<string>")
    def run(s: pd.Series) -> pd.DataFrame:
        known = {v: field(v, sounds, phrases) for v in s.dropna().unique()}
        none = {"text": None, "phonetics": None, "initials": None}
        return pd.DataFrame([none if v is None else known[v] for v in s], columns=["text", "phonetics", "initials"])

    text = words(value, table)
    read = run(F.when(text.rlike(SEARCH_HAN), text))
    none = F.array().cast("array<string>")
    return F.struct(F.coalesce(read["text"], F.replace(text, F.lit(" "), F.lit(""))).alias("text"), F.coalesce(read["phonetics"], none).alias("phonetics"), F.coalesce(read["initials"], none).alias("initials"))


def indexed(songs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Songs with their search index, and the character table that queries need too."""
    spark = songs.sparkSession
    characters = han_characters(songs, ["title", "track", "artist"])
    table = simplified(spark, characters)
    sounds = readings(spark, {*characters, *table.values()})
    shown = F.coalesce(F.nullif("track", F.lit("")), F.col("title"))
    fields = [phonetic_field(c, table, sounds) for c in (shown, F.col("artist"), F.col("title"))]
    return bounded(songs).withColumn("index", F.array(*fields)), table
