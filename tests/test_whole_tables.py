from __future__ import annotations

import re
import unicodedata

import __spark_entry__ as entry
import duckdb

from tessitura.operators import match

SF = "/root/testdata/sf0.001"


def test_rankings_keep_the_newest_500(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").groupBy("user_id").count()
    most = {str(r.user_id): r["count"] for r in events.collect()}
    assert 50 < max(most.values()) <= 500
    played = {r.account_id: r.total_plays for r in entry.queries()["ranking_totals"](spark, SF).collect()}
    listed: dict = {}
    for r in entry.queries()["play_ranking"](spark, SF).collect():
        listed[str(r.account_id)] = listed.get(str(r.account_id), 0) + r.plays
    own = duckdb.sql(f"SELECT user_id, count(*) FROM '{SF}/events.parquet' WHERE regexp_extract(props, '\"k\": ?(-?\\d+)', 1) <> '' GROUP BY 1").fetchall()
    want = {str(u): n for u, n in own}
    assert {str(k): v for k, v in played.items()} == want == listed


def test_containment_has_all_languages_turns_and_whole_names(spark, tmp_path):
    long_ = "extraordinarily-long-hyphenated-first-word and-a-second-one"
    docs = [(1, "ein lied vom meer\nx", "de"), (2, f"on {long_} tonight", "en"), (3, "on extraordinarily-long-hyphenated-first-wo", "en"), (4, None, "fr")]
    turns = [(1, 0, "nothing here"), (1, 1, "vom meer kam er"), (1, 2, "vom meer her"), (2, 0, f"{long_} said"), (3, 0, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in entry.queries()["substring_match"](spark, str(tmp_path)).collect())
    assert got == [(1, 1), (1, 1), (2, 2)]


def test_containment_is_of_letters_not_words(spark):
    titles = spark.createDataFrame([(1, "林小海石橋官方"), (2, "Stonebridge, live"), (3, "sto nebri"), (4, "")], "t long, title string")
    names = spark.createDataFrame([("a", "石橋"), ("b", "BRIDGE"), ("c", "橋"), ("d", "x"), ("e", " "), ("f", "one.bri")], "n string, name string")
    got = sorted((r.t, r.n) for r in match.contained(titles, names, "t", "title", "n", "name").collect())
    assert got == [(1, "a"), (1, "c"), (2, "b"), (2, "f"), (3, "f")]


def test_containment_equals_brute_force(spark):
    def loose(t):
        return re.sub(r"[\s\-–—_·・.,!?！？。、·:：;；'\"“”‘’()（）\[\]【】《》〈〉|丨｜/\\]+", "", unicodedata.normalize("NFKC", t)).casefold()

    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE text IS NOT NULL").fetchall()
    turns = duckdb.sql(f"SELECT conv_id, regexp_extract(text, '^[^ ]+ [^ ]+') FROM '{SF}/conversations.parquet' WHERE text IS NOT NULL").fetchall()
    names = [(c, w) for c, n in turns if (w := loose(n))]
    want = sorted((d, c) for d, t in docs for title in [loose(t.split("\n")[0])] for c, n in names if n in title)
    got = sorted(tuple(r) for r in entry.queries()["substring_match"](spark, SF).collect())
    assert want and got == want


def test_containment_broadcasts_no_runs(spark):
    titles = spark.createDataFrame([(1, "stonebridge live"), (1, "stonebridge live"), (2, "x")], "t long, title string")
    names = spark.createDataFrame([("a", "bridge"), ("b", "bridge")], "n string, name string")
    found = match.contained(titles, names, "t", "title", "n", "name")
    assert sorted((r.t, r.n) for r in found.collect()) == [(1, "a"), (1, "a"), (1, "b"), (1, "b")]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_names_of_other_artists_do_not_meet(spark):
    songs = spark.createDataFrame([(1, "Rain", "A", 10.0), (2, "Rain", "", None), (3, "", "A", 1.0)], "id long, track string, artist string, duration double")
    records = spark.createDataFrame([(1, "rain", "a", 12.0), (2, "rain ", "b", 10.0), (3, None, "a", 1.0)], "record_id long, record_track string, record_artist string, record_duration double")
    found = match.exact_names(songs, records)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 2.0, 1), (2, 1, 12.0, 2), (2, 2, 10.0, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "(ak#" in plan.split("Join Inner, ")[1].split("\n")[0] and "OR" not in plan.split("Join Inner, ")[1].split("\n")[0]
