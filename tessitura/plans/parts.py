"""Queries of operators that larger ones are made of: presence, devices, expiries, edits, sources and tags."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessitura.functions import clock, text
from tessitura.operators import catalog, dedupe, history, imports, jobs, rooms, settings, timed
from tessitura.sources import adapters as A
from tessitura.sources import catalog as documents

from .tables import FILLED, sql

QUERIES, SQL = {}, {}


def query(body: str):
    def add(function):
        QUERIES[function.__name__], SQL[function.__name__] = function, body
        return function

    return add


@query("""WITH p AS (SELECT user_id % 20 AS room_id, user_id % 3 AS member_id, event_id AS ord, (event_id % 9)::VARCHAR AS client_id, event_id % 60 AS seen_at FROM events),
m AS (SELECT * FROM p WHERE 60 - seen_at < 30 QUALIFY row_number() OVER (PARTITION BY room_id, member_id ORDER BY ord, client_id) <= 64)
SELECT room_id, member_id, ord FROM m QUALIFY row_number() OVER (PARTITION BY room_id ORDER BY ord, client_id) <= 128""")
def room_presence(spark, sf):
    k, u = F.col("event_id"), F.col("user_id")
    rows = A.table(spark, sf, "events").select((u % 20).alias("room_id"), (u % 3).alias("member_id"), k.alias("order"), (k % 9).cast("string").alias("client_id"), (k % 60).cast("double").alias("seen_at"))
    return rooms.live_presence(rows, 60.0).select("room_id", "member_id", F.col("order").alias("ord"))


@query("""WITH p AS (SELECT user_id % 20 AS room_id, user_id % 50 AS member_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS device_id, (event_id % 9)::VARCHAR AS client_id, event_id AS ord FROM events),
d AS (SELECT room_id, member_id, coalesce(nullif(device_id, ''), 'client:' || client_id) AS device_key, min(ord) AS first_order FROM p GROUP BY ALL),
n AS (SELECT user_id % 50 AS member_id, event_type AS device_key, arg_max(CASE WHEN event_id % 5 = 0 THEN '' ELSE 'P' || event_id END, (event_id % 7, event_id)) AS own FROM events GROUP BY ALL)
SELECT room_id, member_id, device_key, first_order, CASE WHEN coalesce(own, '') <> '' THEN own ELSE 'shown' END AS label FROM d LEFT JOIN n USING (member_id, device_key)""")
def device_profiles(spark, sf):
    k, u = F.col("event_id"), F.col("user_id")
    e = A.table(spark, sf, "events")
    rows = e.select((u % 20).alias("room_id"), (u % 50).alias("member_id"), F.when(k % 4 == 0, "").otherwise(F.col("event_type")).alias("device_id"), (k % 9).cast("string").alias("client_id"), k.alias("order"), (k % 60).cast("double").alias("seen_at"), F.array(F.lit("player")).alias("roles"), F.lit("shown").alias("label"))
    profiles = e.select((u % 50).alias("member_id"), F.col("event_type").alias("device_id"), (k % 7).alias("version"), k.alias("at"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("P"), k.cast("string"))).alias("label"))
    return rooms.device_rollup(rows, profiles).select("room_id", "member_id", "device_key", F.col("order").alias("first_order"), "label")


@query("SELECT c_custkey AS room_id, c_custkey % 3 AS revision, CASE WHEN c_custkey % 3 <> 1 THEN c_name END AS queue, CASE WHEN c_custkey % 3 <> 1 THEN c_mktsegment END AS playback FROM customer")
def room_changes(spark, sf):
    k = F.col("c_custkey")
    rows = A.table(spark, sf, "customer").select(k.alias("room_id"), (k % 3).alias("revision"), F.col("c_name").alias("queue"), F.lit(None).cast("string").alias("current"), F.col("c_mktsegment").alias("playback"))
    return rooms.public_view(rows, 1).drop("current")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 1 THEN 'New' ELSE p_brand END AS first_singer, 'other' AS second_singer FROM part")
def renamed_singers(spark, sf):
    singer = lambda ident, name: F.struct(ident.cast("string").alias("id"), name.alias("name"))
    rows = A.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(singer(F.col("p_size") % 3, F.col("p_brand")), singer(F.lit("x"), F.lit("other"))).alias("singers"))
    return rooms.renamed_member(rows, "1", "New").select("id", F.col("singers")[0]["name"].alias("first_singer"), F.col("singers")[1]["name"].alias("second_singer"))


@query("""WITH m AS (SELECT c_nationkey AS room_id, c_custkey AS member_id, c_custkey % 11 AS account, c_custkey = min(c_custkey) OVER (PARTITION BY c_nationkey) AS host, c_custkey % 100 AS joined_at FROM customer),
g AS (SELECT *, account = 3 AND room_id <> 5 AS gone FROM m), l AS (SELECT *, bool_or(gone AND host) OVER (PARTITION BY room_id) AS lost, row_number() OVER (PARTITION BY room_id, gone ORDER BY joined_at, member_id) AS n FROM g)
SELECT room_id, member_id, CASE WHEN lost THEN n = 1 ELSE host END AS host FROM l WHERE NOT gone""")
def moved_members(spark, sf):
    k = F.col("c_custkey")
    host = k == F.min("c_custkey").over(Window.partitionBy("c_nationkey"))
    rows = A.table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("room_id"), k.alias("member_id"), (k % 11).cast("string").alias("account_id"), host.alias("host"), (k % 100).alias("joined_at"))
    return rooms.moved_account(rows, "3", "5").select(F.col("room_id").cast("int").alias("room_id"), "member_id", "host")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 IN (0, 1) THEN trim(CASE WHEN c_custkey % 4 = 0 THEN '  ' || c_name || ' ' ELSE c_mktsegment END) END AS label,
  replace(replace(replace(replace(CASE WHEN c_custkey % 2 = 0 THEN c_name || '[x]*' ELSE '?' || c_name END, '[', '<'), ']', '[]]'), '<', '[[]'), '*', '[*]') AS glob0 FROM customer""")
def safe_labels(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_name")
    raw = F.when(k % 4 == 0, F.concat(F.lit("  "), n, F.lit(" "))).when(k % 4 == 1, F.col("c_mktsegment")).when(k % 4 == 2, F.concat(n, F.lit("\t"), n)).otherwise(F.repeat(n, F.lit(9)))
    glob = F.replace(text.glob_escape(F.when(k % 2 == 0, F.concat(n, F.lit("[x]*"))).otherwise(F.concat(F.lit("?"), n))), F.lit("[?]"), F.lit("?"))
    return A.table(spark, sf, "customer").select(k.alias("id"), text.label(raw).alias("label"), glob.alias("glob0"))


@query("""SELECT o_orderkey AS id, least(o_custkey + 43200, o_orderkey + 172800)::DOUBLE AS room_end, least(o_custkey::DOUBLE, 100 + least(o_totalprice / 100 + 300, 1200.0)) AS trial_end,
  floor(-20 + 60 * greatest(0, least(100, o_custkey % 150)) / 100)::BIGINT AS level, left(sha256(o_orderstatus || chr(31) || o_orderpriority), 16) AS pseudonym FROM orders""")
def expiries(spark, sf):
    k, c = F.col("o_orderkey").cast("double"), F.col("o_custkey").cast("double")
    return A.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), clock.room_expiry(k, c).cast("double").alias("room_end"), clock.trial_expiry(c, F.lit(100.0), F.col("o_totalprice") / 100).alias("trial_end"),
        clock.scaled(F.lit(-20), F.lit(40), F.col("o_custkey") % 150).cast("long").alias("level"), clock.pseudonym(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("pseudonym"),
    )


@query("""WITH b AS (SELECT c_nationkey::VARCHAR AS account_id, c_custkey::VARCHAR AS device_id, 'own ' || c_custkey AS label, (c_custkey % 10)::DOUBLE AS created_at, 5.0::DOUBLE AS last_seen_at FROM customer WHERE c_custkey % 5 = 0),
v AS (SELECT c_nationkey::VARCHAR AS account_id, c_custkey::VARCHAR AS device_id, min(o_orderkey % 1000)::DOUBLE AS f, max(o_orderkey % 1000)::DOUBLE AS l FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
m AS (SELECT account_id, device_id, label, b.created_at, last_seen_at, f, l, row_number() OVER (PARTITION BY account_id ORDER BY coalesce(b.created_at, f), device_id) AS n FROM b FULL JOIN v USING (account_id, device_id))
SELECT account_id, device_id, coalesce(label, 'device ' || n) AS label, coalesce(created_at, f) AS created_at, greatest(last_seen_at, l) AS last_seen_at FROM m WHERE created_at IS NOT NULL OR n <= 24""")
def devices_touched(spark, sf):
    c = A.table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("account_id"), F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("device_id"))
    base = c.where("k % 5 = 0").select("account_id", "device_id", F.concat(F.lit("own "), "device_id").alias("label"), (F.col("k") % 10).cast("double").alias("created_at"), F.lit(5.0).alias("last_seen_at"))
    visits = A.table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("k")).select("account_id", "device_id", (F.col("o_orderkey") % 1000).cast("double").alias("at"))
    return settings.register(base, visits).select("account_id", "device_id", "label", "created_at", "last_seen_at")


@query("SELECT c_custkey::VARCHAR AS device_id, c_name AS label, CASE WHEN c_custkey % 2 = 0 THEN 'player' ELSE '' END AS known, c_custkey % 2 = 0 AS valid FROM customer WHERE c_nationkey = 7 AND c_custkey % 10 = 4 OR c_custkey = 1")
def device_roles(spark, sf):
    c = A.table(spark, sf, "customer")
    listed = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("player"), F.lit("player"))).otherwise(F.array(F.lit("pilot")))
    rows = c.where("c_nationkey = 7 AND c_custkey % 10 = 4 OR c_custkey = 1")
    return rows.select(F.col("c_custkey").cast("string").alias("device_id"), F.col("c_name").alias("label"), F.array_join(settings.roles(listed), ",").alias("known"), settings.roles_valid(listed).alias("valid"))


@query("SELECT lower(p_brand) AS artist_key, lower(p_type) AS track_key, count(*) AS group_size FROM part GROUP BY ALL")
def groups_by_size(spark, sf):
    rows = A.table(spark, sf, "part").select(F.lower("p_brand").alias("artist_key"), F.lower("p_type").alias("track_key"))
    return dedupe.largest_first(rows.withColumn("group_size", F.count(F.lit(1)).over(Window.partitionBy("artist_key", "track_key"))))


@query("""WITH s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS a, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS b FROM part),
n AS (SELECT p_name AS a, min(p_brand) AS v FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), t AS (SELECT p_type AS b, min(p_brand) AS v FROM part WHERE p_partkey % 2 = 0 GROUP BY 1)
SELECT id, coalesce(n.v, t.v) AS brand FROM s LEFT JOIN n USING (a) LEFT JOIN t USING (b)""")
def first_directory_match(spark, sf):
    k = F.col("p_partkey")
    part = A.table(spark, sf, "part")
    rows = part.select(k.alias("id"), F.when(k % 3 == 0, F.col("p_name")).alias("a"), F.when(k % 2 == 0, F.col("p_type")).alias("b"))
    directory = part.where(k % 2 == 0).select(F.col("p_name").alias("a"), F.col("p_type").alias("b"), F.col("p_brand").alias("brand"))
    return catalog.first_match(rows, directory, ["a", "b"], "brand").select("id", "brand")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'synced' WHEN p_size % 4 = 1 THEN 'plain' ELSE 'error' END AS kind, CASE WHEN p_size % 5 = 0 THEN 'database' WHEN p_size % 2 = 0 THEN 'subtitles' WHEN p_size % 3 = 0 THEN 'recognition' END AS source, p_size % 7 = p_size % 3 AS same FROM part")
def lyric_sources(spark, sf):
    n = F.col("p_size")
    some = lambda when: F.when(when, F.array(F.col("p_name"))).otherwise(F.array().cast("array<string>"))
    rows = A.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), n, F.when(n % 4 == 0, "x").alias("synced"), F.when(n % 4 <= 1, "y").otherwise("").alias("plain"), some(n % 5 == 0).alias("database"), some(n % 2 == 0).alias("subtitles"), some(n % 3 == 0).alias("recognition"))
    found = catalog.lyric_source(catalog.timed_or_plain(rows), ["database", "subtitles", "recognition"])
    return found.select("id", "kind", "source", catalog.same_source(n % 7, n % 3, F.lit(True), F.lit(False)).alias("same"))


@query("SELECT p_partkey AS id, p_size % 2 = 0 AND p_size % 3 <> 0 AND p_size % 5 <> 0 AS reusable FROM part")
def stems_to_reuse(spark, sf):
    n = F.col("p_size")
    part = A.table(spark, sf, "part").select(F.col("p_partkey").alias("job_id"), n)
    stems = part.where(n % 5 != 0).select("job_id", (n % 2).alias("identity"), F.when(n % 3 != 0, 1).otherwise(2).alias("model"), F.lit("f").alias("fingerprint"))
    out = jobs.reusable_stems(part.withColumns({"identity": F.lit(0), "model": F.lit(1), "fingerprint": F.lit("f")}), stems)
    return out.select(F.col("job_id").alias("id"), F.coalesce("reusable", F.lit(False)).alias("reusable"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 'invalid' WHEN c_custkey % 3 = 0 THEN 'account changed' END AS wrong FROM customer")
def reply_errors(spark, sf):
    k = F.col("c_custkey")
    rows = A.table(spark, sf, "customer").select(k.alias("id"), k.alias("account_id"), (k + F.when(k % 3 == 0, 1).otherwise(0)).alias("asked_by"), F.when(k % 5 != 0, F.array(F.lit("s"))).alias("songs"), F.when(k % 7 == 0, -1).otherwise(3).alias("total_plays"), F.lit(50).alias("history_limit"))
    return history.valid_statistics(rows).select("id", "wrong")


@query(sql(", k AS (SELECT job_id, line_no AS old, start_ms, end_ms, trim(CASE WHEN line_no % 4 = 1 THEN '  ' ELSE text END) AS text FROM filled) SELECT job_id, (row_number() OVER (PARTITION BY job_id ORDER BY start_ms, old) - 1) AS line_no, text FROM k WHERE text <> ''", FILLED))
def edited_order(spark, sf):
    rows = A.lines(spark, sf).withColumn("text", F.when(F.col("line_no") % 4 == 1, "  ").otherwise(F.col("text")))
    return timed.normalized_edit(rows).select("job_id", "line_no", "text")


@query("""WITH w AS (SELECT p_partkey AS id, p_size::DOUBLE AS a, p_size + 2.0::DOUBLE AS b FROM part)
SELECT id, greatest(10.0, least(14.0, 10.0 + (a - 5) * 4.0 / 20))::DOUBLE AS s, greatest(10.0, least(14.0, 10.0 + (b - 5) * 4.0 / 20))::DOUBLE AS e FROM w""")
def retimed_words(spark, sf):
    n = F.col("p_size").cast("double")
    word = F.array(F.struct(F.col("p_name").alias("text"), n.alias("start"), (n + 2).alias("end")))
    rows = A.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), timed.retime(word, F.lit(5.0), F.lit(25.0), F.lit(10.0), F.lit(14.0)).alias("w"))
    return rows.select("id", F.col("w")[0]["start"].alias("s"), F.col("w")[0]["end"].alias("e"))


@query("SELECT p_partkey AS id, (SELECT count(*) FROM part) > 50 AS truncated FROM part ORDER BY p_partkey LIMIT 50")
def first_of_listing(spark, sf):
    return imports.truncated(A.table(spark, sf, "part").select(F.col("p_partkey").alias("id")), "id", 50)


@query("""WITH d AS (SELECT (row_number() OVER (ORDER BY p_partkey) - 1) // 4096 AS node, p_partkey, sha256('{"p_partkey":' || p_partkey || ',"p_brand":"' || p_brand || '"}') AS d FROM part),
n AS (SELECT node, count(*) AS c, sha256(string_agg(d, '' ORDER BY p_partkey)) AS d FROM d GROUP BY node)
SELECT 'W/"' || CASE WHEN count(*) > 1 THEN sha256(string_agg(d, '' ORDER BY node)) ELSE min(d) END || '"' AS etag FROM n""")
def catalog_tag(spark, sf):
    return documents.etag(A.table(spark, sf, "part").select("p_partkey", "p_brand"), ["p_partkey"])
