from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessitura.functions import phonetic, search
from tessitura.functions.text import fold, parse_query
from tessitura.operators.browse import letter

#: id, track, artist, original title. The rules that they stand for: exact before prefix before inner hits, title before
#: artist before original title, sounds and initials after letters, scripts and widths folded, ties by id.
SONGS = [
    ("full", "石橋", "林小海", "林小海 Sea Lin - 石橋 (MV)"),
    ("prefix", "石橋夜話", "白石", "石橋夜話"),
    ("inner", "走過石橋", "白石", "走過石橋"),
    ("artist", "遠方", "石橋", "遠方"),
    ("raw", "現場一", "某人", "石橋"),
    ("latin", "shiqiao", "Demo", "shiqiao"),
    ("western", "Paper Boats", "Ｂｌｕｅ Ｈａｒｂｏｒ", "Video"),
    ("accent", "Été à Nîmes", "Zoé", "Été à Nîmes"),
    ("marks", "Can't Wait (Live)", "A/B", "Show"),
    ("mixed", "K-9 小狗", "K-9", "晚會"),
    ("umlaut", "綠島", "吕青", "綠島"),
    ("twin-b", "清風", "雲", "一"),
    ("twin-a", "清風", "雲", "一"),
    ("nothing", None, None, None),
]
#: query -> what must be found, in order; every rule has one.
FOUND = {
    "石橋": ["full", "artist", "raw", "prefix", "inner"],
    "石桥": ["full", "artist", "raw", "prefix", "inner"],
    "林小海石橋": ["full"],
    "石橋  ／ 林小海": ["full"],
    "linxiaohai 石橋": ["full"],
    "lxh sq": ["full"],
    "lǘdǎo": ["umlaut"],
    "lv dao": ["umlaut"],
    "boats paper ＢＬＵＥ": ["western"],
    "  ETE   a—nimes zoe": ["accent"],
    "CAN'T WAIT": ["marks"],
    "cantwaitlive": ["marks"],
    "K9 小狗": ["mixed"],
    "清風": ["twin-a", "twin-b"],
    "石橋 雲": [],
    "<b>x</b>": [],
}


@pytest.fixture(scope="module")
def catalog(spark):
    indexed, table = phonetic.indexed(spark.createDataFrame(SONGS, "id string, track string, artist string, title string"))
    table |= phonetic.simplified(spark, {c for q in FOUND for c in q if ord(c) > 0x3400})
    return indexed.cache(), table


@pytest.mark.parametrize("query", list(FOUND))
def test_found_in_order(catalog, query):
    songs, table = catalog
    assert [r.id for r in search.search(songs, query, table).select("id").collect()] == FOUND[query]


def test_sounds_come_after_letters(catalog):
    songs, table = catalog
    got = [r.id for r in search.search(songs, "shiqiao", table).select("id").collect()]
    assert got[0] == "latin" and set(got[1:]) == {"full", "artist", "raw", "prefix", "inner"} and got[1] == "full"


def test_an_empty_query_finds_all(catalog):
    songs, table = catalog
    assert search.search(songs, " … ", table).count() == len(SONGS)
    assert [r.id for r in search.search(songs, "石橋", table, most=2).select("id").collect()] == ["full", "artist"]


def test_letters_go_by_sound_or_fold(spark):
    names = {"石橋": "S", "Été": "E", "ｂａｒ": "B", "7 days": "#", "🎵": "#", "": "#", "重慶": "C", None: "#"}
    rows = phonetic.indexed(spark.createDataFrame([(n, "雲", n) for n in names], "track string, artist string, title string"))[0]
    got = rows.select("track", letter(F.col("index").getItem(0)).alias("a"), letter(F.col("index").getItem(1)).alias("b")).collect()
    assert {r.track: r.a for r in got} == names and {r.b for r in got} == {"Y"}


def test_folding():
    assert fold("Ｋ／９ Straße ς") == "k/9 strasse σ"
    assert parse_query("石shi橋 A1") == ("石shi橋a1", ["石", "shi", "橋", "a1"]) and parse_query(None) == ("", [])
