"""Queries of play history and browsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessitura.functions import phonetic
from tessitura.operators import browse, history
from tessitura.sources import adapters as A

from .tables import CATALOG, PLAYS, WORDS, sql

QUERIES, SQL = {}, {}


def query(text: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if text:
            SQL[function.__name__] = text
        return function

    return add


KEPT = ", kept AS (SELECT * FROM plays QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY id DESC) <= 500)"
RANKED = KEPT + """, ranked AS (
  SELECT account_id, job_id, count(*) AS plays, max(started_at) AS last_played_at,
         row_number() OVER (PARTITION BY account_id ORDER BY count(*) DESC, max(started_at) DESC, job_id) AS place
  FROM kept WHERE job_id <> '' GROUP BY account_id, job_id)"""


@query(sql(RANKED + " SELECT * FROM ranked WHERE place <= 500", PLAYS))
def play_ranking(spark, sf):
    return history.ranking(history.retain(A.plays(spark, sf)))


@query(sql(RANKED + " SELECT account_id, sum(plays)::BIGINT AS total_plays, count(*) AS songs FROM ranked WHERE place <= 500 GROUP BY 1", PLAYS))
def ranking_totals(spark, sf):
    return history.ranking_totals(history.ranking(history.retain(A.plays(spark, sf))))


FOLD = """, fold AS (
  SELECT account_id, play_key, min(id) AS id, arg_min(started_at, id) AS started_at, arg_max(started_at, id) AS updated_at,
         max(greatest(position, 0)) AS position, bool_or(completed) AS completed, arg_min(job_id, id) AS job_id, arg_max(device_id, id) AS device_id
  FROM plays GROUP BY account_id, play_key)"""


@query(sql(FOLD + " SELECT * FROM fold", PLAYS))
def play_upsert_fold(spark, sf):
    return history.upsert_plays(A.plays(spark, sf))


@query(sql(FOLD + """, ended AS (
  SELECT account_id, play_key, max(started_at + 60) AS till, max(greatest(position + 5, 0)) AS p FROM plays WHERE device_id = 'view' GROUP BY 1, 2)
SELECT f.account_id, f.play_key, id, started_at, coalesce(till, updated_at) AS updated_at, greatest(f.position, coalesce(p, f.position)) AS position,
       completed OR till IS NOT NULL AS completed, job_id, device_id
FROM fold f LEFT JOIN ended e USING (account_id, play_key)""", PLAYS))
def play_completion(spark, sf):
    plays = A.plays(spark, sf)
    ended = plays.where("device_id = 'view'").select("account_id", "play_key", (F.col("started_at") + 60).alias("at"), (F.col("position") + 5).alias("position"))
    return history.complete_plays(history.upsert_plays(plays), ended)


@query(sql(FOLD + """, devices AS (
  SELECT account_id, device_id, CASE WHEN min(id) % 3 = 0 THEN '' ELSE upper(device_id) END AS label FROM plays WHERE id % 2 = 0 GROUP BY 1, 2)
SELECT f.account_id, f.play_key, f.id, f.device_id, coalesce(nullif(label, ''), 'stored ' || f.device_id) AS device_label
FROM fold f LEFT JOIN devices USING (account_id, device_id)""", PLAYS))
def history_labels(spark, sf):
    plays = A.plays(spark, sf)
    label = F.when(F.min("id") % 3 == 0, "").otherwise(F.upper("device_id"))
    devices = plays.where("id % 2 = 0").groupBy("account_id", "device_id").agg(label.alias("label"))
    own = history.upsert_plays(plays).withColumn("device_label", F.concat(F.lit("stored "), "device_id"))
    return history.with_device_label(own, devices).select("account_id", "play_key", "id", "device_id", "device_label")


@query("""
WITH own AS (SELECT o_orderkey AS id, o_custkey::VARCHAR AS account_id, c_name AS label, o_orderstatus AS status FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
f AS (SELECT * FROM own WHERE account_id = '7' AND id < 100000 ORDER BY id DESC LIMIT 4)
SELECT *, CASE WHEN (SELECT count(*) FROM f) > 3 THEN (SELECT min(id) FROM (SELECT id FROM f ORDER BY id DESC LIMIT 3)) END AS next_before
FROM f ORDER BY id DESC LIMIT 3""")
def history_page(spark, sf):
    orders, customer = A.table(spark, sf, "orders"), A.table(spark, sf, "customer")
    own = orders.join(customer, orders.o_custkey == customer.c_custkey, "left")
    rows = own.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("account_id"), F.col("c_name").alias("label"), F.col("o_orderstatus").alias("status"))
    return history.page(rows, "7", 3, 100000)


@query(sql(" SELECT * FROM plays WHERE NOT (id % 5 = 0)", PLAYS))
def history_delete(spark, sf):
    plays = A.plays(spark, sf)
    return history.delete_entries(plays, plays.where("id % 5 = 0"))


@query(sql(" SELECT * FROM plays WHERE account_id::BIGINT % 10 <> 3", PLAYS))
def history_clear(spark, sf):
    plays = A.plays(spark, sf)
    return history.clear(plays, plays.where("account_id % 10 = 3"))


@query("""SELECT l_suppkey AS account_id, l_orderkey * 10 + l_linenumber AS id, l_returnflag FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber DESC) <= 100""")
def retention_topn(spark, sf):
    rows = A.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("account_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_returnflag")
    return history.retain(rows, 100)


@query("""SELECT event_type AS kind, event_id AS id, user_id AS job_id FROM events
QUALIFY event_type = 'error' OR row_number() OVER (PARTITION BY user_id, event_type <> 'error' ORDER BY event_id DESC) <= 5""")
def bounded_log(spark, sf):
    rows = A.table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.col("user_id").alias("job_id"))
    return history.keep_newest(rows, ["job_id"], "id", 5, "kind <> 'error'")


@query(sql(" SELECT count(DISTINCT account_id) AS accounts, count(DISTINCT job_id) AS rooms FROM plays", PLAYS))
def distinct_accounts(spark, sf):
    return history.occupied(A.plays(spark, sf), room="job_id")


@query(sql(" SELECT account_id, count(*) AS total FROM plays GROUP BY 1", PLAYS))
def account_counts(spark, sf):
    return history.counts(A.plays(spark, sf))


BUCKET = """CASE WHEN regexp_matches(title, '(?i)粤语|粵語|廣東話|广东话|cantonese') THEN '粤语'
 WHEN regexp_matches(title, '(?i)国语|國語|普通话|普通話|华语|華語|mandarin') THEN '国语'
 WHEN regexp_matches(title, '(?i)日语|日語|japanese|j-?pop') THEN '日语'
 WHEN regexp_matches(title, '(?i)韩语|韓語|korean|k-?pop') THEN '韩语'
 WHEN regexp_matches(title, '(?i)闽南|閩南|台语|台語|hokkien') THEN '闽南语'
 WHEN regexp_matches(title, '[\\x{4e00}-\\x{9fff}]') THEN '国语' WHEN regexp_matches(title, '[a-zA-Z]') THEN '英语' ELSE '其他' END"""
LETTER = "CASE WHEN regexp_matches(left({0}, 1), '^[a-z]$') THEN upper(left({0}, 1)) ELSE '#' END"
INFO = f""", info AS (
  SELECT id, coalesce(nullif(title, ''), '未命名') AS shown_title, coalesce(artist, '') AS shown_artist, {BUCKET} AS lang,
         len(regexp_extract_all(coalesce(nullif(title, ''), '未命名'), '[\\x{{4e00}}-\\x{{9fff}}]')) AS chars,
         {LETTER.format("replace(" + WORDS.format('title') + ", ' ', '')")} AS letter, {LETTER.format("replace(" + WORDS.format('artist') + ", ' ', '')")} AS artist_letter
  FROM catalog)"""


def _info(spark, sf):
    songs = phonetic.indexed(A.catalog(spark, sf).withColumn("track", F.lit(None).cast("string")))[0]
    return browse.song_info(songs).select("id", "shown_title", "shown_artist", "lang", "chars", "letter", "artist_letter")


@query(sql(INFO + " SELECT * FROM info", CATALOG))
def song_info(spark, sf):
    return _info(spark, sf)


@query(sql(INFO + " SELECT lang, count(*) AS n FROM info GROUP BY 1", CATALOG))
def language_facet(spark, sf):
    return browse.facet(_info(spark, sf), "lang")


@query(sql(INFO + """, letters AS (SELECT unnest([chr(c::INTEGER) FOR c IN range(65, 91)] || ['#']) AS letter)
SELECT letter, count(id) AS n, (SELECT count(*) FROM info) AS total FROM letters LEFT JOIN info USING (letter) GROUP BY 1""", CATALOG))
def letter_facet(spark, sf):
    return browse.letter_facet(_info(spark, sf))


@query("""WITH e AS (SELECT lower(p_brand) AS key, p_type AS spelling, count(*) AS n, min(p_partkey) AS seen FROM part GROUP BY 1, 2)
SELECT key, sum(n)::BIGINT AS size, first(spelling ORDER BY n DESC, seen) AS label FROM e GROUP BY 1""")
def artist_groups_mode(spark, sf):
    part = A.table(spark, sf, "part").select(F.lower("p_brand").alias("key"), F.col("p_type").alias("spelling"), F.col("p_partkey").alias("position"))
    return browse.artist_groups(part, "key", "spelling", "position")


@query(sql(RANKED + " SELECT account_id, job_id, lang, plays, last_played_at FROM documents JOIN ranked ON doc_id::VARCHAR = job_id WHERE place <= 500", PLAYS))
def popular_join(spark, sf):
    songs = A.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("job_id"), "lang")
    ranked = history.ranking(history.retain(A.plays(spark, sf))).select("account_id", "job_id", "plays", "last_played_at")
    return browse.popular(songs, ranked)


@query("SELECT p_partkey, p_name, 3::BIGINT AS page, ceil((SELECT count(*) FROM part) / 24.0)::BIGINT AS pages FROM part ORDER BY p_name, p_partkey LIMIT 24 OFFSET 48")
def offset_page(spark, sf):
    return browse.offset_page(A.table(spark, sf, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], 3)


@query("SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name, p_partkey) AS row FROM part")
def numbered_rows(spark, sf):
    return browse.numbered(A.table(spark, sf, "part").select("p_partkey", "p_name"), [F.col("p_name"), F.col("p_partkey")])


@query(sql(" SELECT id, line_count FROM catalog WHERE coalesce(line_count, 0) <= 0", CATALOG))
def without_lyrics(spark, sf):
    return browse.without_lyrics(A.catalog(spark, sf)).select("id", F.col("line_count").cast("long").alias("line_count"))


@query("""SELECT source, doc_id, lang FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) = 1""")
def latest_match(spark, sf):
    docs = A.table(spark, sf, "documents").join(A.table(spark, sf, "labels"), "doc_id", "left")
    rows = docs.select("source", "doc_id", "lang", "n_chars", F.when(F.col("quality").isNotNull(), "done").otherwise("queued").alias("state"))
    return history.latest_match(rows, "source", ["n_chars", "doc_id"], ["done"]).select("source", "doc_id", "lang")
