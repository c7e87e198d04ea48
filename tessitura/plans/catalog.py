"""Queries of the small catalog operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessitura.operators import catalog
from tessitura.sources import adapters as A
from tessitura.sources import catalog as sources

from .tables import CATALOG, sql

QUERIES, SQL = {}, {}


def query(body: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if body:
            SQL[function.__name__] = body
        return function

    return add


@query("SELECT page_id, sha256(html) AS sha256, octet_length(encode(html)) AS size FROM pages")
def content_digests(spark, sf):
    return catalog.digests(A.table(spark, sf, "pages"), "page_id", "html")


@query(sql(" SELECT id, artist FROM catalog WHERE state = 'done' AND id % 4 <> 0", CATALOG))
def playable_songs(spark, sf):
    songs = A.catalog(spark, sf).withColumn("instrumental", F.when(F.col("id") % 4 == 0, "").otherwise("i.mp3"))
    return catalog.playable(songs).select("id", "artist")


@query(sql(""", m AS (SELECT id, left(trim(coalesce(CASE WHEN id % 5 <> 0 THEN title END, '')), 40) AS t, left(trim(CASE WHEN id % 3 <> 0 THEN artist ELSE '' END), 40) AS k, left(trim(coalesce(artist, '')), 40) AS artist, duration FROM catalog),
n AS (SELECT *, coalesce(nullif(t, ''), nullif(k, ''), 'Untitled song') AS title FROM m) SELECT id, title, coalesce(nullif(k, ''), title) AS track, artist, duration FROM n""", CATALOG))
def safe_metadata(spark, sf):
    songs = A.catalog(spark, sf).withColumns({"track": F.when(F.col("id") % 3 != 0, F.col("artist")).otherwise(""), "title": F.when(F.col("id") % 5 != 0, F.col("title"))})
    return catalog.safe_metadata(songs, 40)


@query("""WITH j AS (SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 5 = 1 THEN 'Official' WHEN p_size % 5 = 2 THEN p_brand || ' • 49M plays' ELSE p_brand END AS artist, p_name AS track,
  CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN p_type END AS planned, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE left(p_name, 5) END AS planned_track, p_size % 5 AS kind, p_brand FROM part),
c AS (SELECT *, CASE WHEN kind < 2 THEN '' ELSE p_brand END AS clean FROM j), k AS (SELECT *, clean <> '' AND coalesce(planned, '') <> artist AND coalesce(planned, '') <> clean AS keeps FROM c)
SELECT id, CASE WHEN keeps THEN clean ELSE planned END AS planned_artist, CASE WHEN keeps THEN planned_track <> track OR clean <> artist ELSE true END AS changed FROM k""")
def keep_artist(spark, sf):
    n, k = F.col("p_size") % 5, F.col("p_partkey")
    artist = F.when(n == 0, "").when(n == 1, "Official").when(n == 2, F.concat("p_brand", F.lit(" • 49M plays"))).otherwise(F.col("p_brand"))
    planned = F.when(k % 3 == 0, F.col("p_brand")).when(k % 3 == 1, F.col("p_type"))
    jobs = A.table(spark, sf, "part").select(k.alias("id"), artist.alias("artist"), F.col("p_name").alias("track"), planned.alias("planned_artist"), F.when(k % 2 == 0, F.col("p_name")).otherwise(F.left("p_name", F.lit(5))).alias("planned_track"), F.lit(True).alias("changed"))
    return catalog.keep_artist(jobs).select("id", "planned_artist", "changed")


@query(sql(" SELECT id FROM catalog WHERE state = 'done' AND coalesce(line_count, 0) <= 4", CATALOG))
def songs_to_refetch(spark, sf):
    return catalog.to_maintain(A.catalog(spark, sf), most_lines=4).select("id")


@query(sql(" SELECT id FROM catalog WHERE state = 'done' AND trim(CASE WHEN id % 3 = 0 THEN ' ' WHEN id % 3 = 1 THEN artist END) IS DISTINCT FROM artist", CATALOG))
def songs_without_artist(spark, sf):
    artist = F.when(F.col("id") % 3 == 0, " ").when(F.col("id") % 3 == 1, F.col("artist"))
    return catalog.to_maintain(A.catalog(spark, sf).withColumn("artist", artist), without_artist=True).select("id")


@query(sql(" SELECT id, id IN (SELECT o_custkey FROM orders) AS queued FROM catalog", CATALOG))
def queued_markers(spark, sf):
    queue = A.table(spark, sf, "orders").select(F.col("o_custkey").alias("job_id"))
    return catalog.queued_markers(A.catalog(spark, sf).select("id"), queue)


@query("""WITH d AS (SELECT c_nationkey AS client, c_custkey % 40 AS device, c_name AS label FROM customer)
SELECT s_suppkey, coalesce((SELECT min(label) FROM d WHERE client = s_nationkey + 5), (SELECT min(label) FROM d WHERE device = s_suppkey % 60)) AS label FROM supplier""")
def first_match(spark, sf):
    directory = A.table(spark, sf, "customer").select(F.col("c_nationkey").alias("client"), (F.col("c_custkey") % 40).alias("device"), F.col("c_name").alias("label"))
    rows = A.table(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") + 5).alias("client"), (F.col("s_suppkey") % 60).alias("device"))
    return catalog.first_match(rows, directory, ["client", "device"], "label").select("s_suppkey", "label")


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'database' WHEN turn % 3 = 1 THEN 'subtitles' ELSE 'recognition' END AS source FROM conversations""")
def lyric_source(spark, sf):
    lines = lambda k: F.when(F.col("turn") % 3 <= k, F.array("text"))
    rows = A.table(spark, sf, "conversations").select("conv_id", "turn", lines(0).alias("database"), lines(1).alias("subtitles"), F.array("text").alias("recognition"))
    return catalog.lyric_source(rows, ["database", "subtitles", "recognition"]).select("conv_id", "turn", "source")


@query()
def collated_labels(spark, sf):
    return catalog.collated(A.table(spark, sf, "documents").select("source").distinct(), "source")


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 11 = 0 THEN 'disabled' WHEN p_size % 7 = 0 OR p_size % 5 = 0 THEN 'failed' WHEN p_partkey % 13 = 0 THEN 'skipped' WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'archived'
  WHEN p_partkey % 3 = 0 THEN 'conflict' WHEN p_partkey % 17 = 0 THEN 'failed' ELSE 'archived' END AS outcome FROM part""")
def archive_outcomes(spark, sf):
    n, k = F.col("p_size"), F.col("p_partkey")
    files = A.table(spark, sf, "part").select(
        k.alias("id"), F.when(n % 11 != 0, "/library").alias("library"), (n % 7 != 0).alias("library_there"), (n % 5 != 0).alias("source_there"), F.when(k % 13 != 0, F.col("p_name")).alias("name"),
        (k % 3 == 0).alias("target_there"), (k % 2 == 0).alias("same_file"), F.when(k % 17 == 0, "no space").alias("error"),
    )
    return catalog.archive_outcome(files).select("id", "outcome")


@query("""WITH j AS (SELECT doc_id AS id, string_split(text, chr(10))[1] AS title, CASE doc_id % 4 WHEN 0 THEN 'http://h/x.jpg' WHEN 1 THEN 'cover.jpg' WHEN 2 THEN '/data/jobs/' || doc_id || '/art/c.png' END AS thumbnail,
  CASE WHEN doc_id % 3 = 0 THEN 'own' END AS track, doc_id % 5 = 0 AS sourced, source AS artist FROM documents)
SELECT id::VARCHAR AS id, CASE id % 4 WHEN 1 THEN '/media/' || id || '/cover.jpg' WHEN 2 THEN '/media/' || id || '/art/c.png' ELSE thumbnail END AS thumbnail,
  CASE WHEN track IS NULL AND sourced THEN 'The Singers' ELSE artist END AS artist, CASE WHEN track IS NULL AND sourced THEN 'The - Song' ELSE coalesce(track, 'plain') END AS track,
  CASE WHEN id % 2 = 0 THEN '/media/' || id || '/stems/i.mp3' END AS instrumental, CASE WHEN id % 6 = 0 THEN 1 ELSE 0 END AS recordings FROM j""")
def public_catalog(spark, sf):
    k, none = F.col("doc_id"), F.lit(None).cast("string")
    ident = k.cast("string")
    recording = F.struct(F.when(k % 6 == 0, "r.webm").alias("file"), F.lit("t").alias("title"))
    jobs = A.table(spark, sf, "documents").select(
        ident.alias("id"), F.lit("plain").alias("title"), F.when(k % 4 == 0, "http://h/x.jpg").when(k % 4 == 1, "cover.jpg").when(k % 4 == 2, F.concat(F.lit("/data/jobs/"), ident, F.lit("/art/c.png"))).alias("thumbnail"),
        F.when(k % 3 == 0, "own").alias("track"), F.col("source").alias("artist"), F.when(k % 5 == 0, "LRCLIB · The Singers - The - Song · x").alias("lyrics_source"), none.alias("lyrics_file"), F.lit("g").alias("generation"),
        F.struct(F.when(k % 2 == 0, "i.mp3").otherwise("").alias("instrumental"), none.alias("vocals")).alias("stems"), F.array(recording).alias("recordings"),
    )
    return sources.public_jobs(jobs).select("id", "thumbnail", "artist", "track", F.col("media")["instrumental"].alias("instrumental"), F.size("recordings").cast("long").alias("recordings"))
