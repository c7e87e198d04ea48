"""Queries of text functions, search, titles, duplicates and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessitura.functions import clock, search, text, titles
from tessitura.operators import dedupe, match
from tessitura.sources import adapters as A

from .tables import CATALOG, WORDS, sql

QUERIES, SQL = {}, {}


def query(body: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if body:
            SQL[function.__name__] = body
        return function

    return add


def _docs(spark, sf):
    return A.table(spark, sf, "documents")


@query(f"SELECT doc_id, sha256({WORDS.format('text')}) AS folded, replace({WORDS.format('source')}, ' ', '') AS key FROM documents")
def fold_text(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(text.words(F.col("text")), 256).alias("folded"), text.normalize(F.col("source")).alias("key"))


PUNCT = """[\\s\\-_·,，.。''’"“”!！?？()（）\\[\\]【】~～/／]"""
MATCH = """[\\s\\-_·,，.。''’"“”!！?？()（）\\[\\]【】]"""


@query(f"SELECT page_id, regexp_replace(lower(trim(url)), '{PUNCT}', '', 'g') AS dedupe, lower(regexp_replace(trim(url), '{MATCH}', '', 'g')) AS match FROM pages")
def name_keys(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", text.dedupe_key(F.col("url")).alias("dedupe"), text.match_key(F.col("url")).alias("match"))


@query("SELECT doc_id, length(text) + len(regexp_extract_all(text, '[\\x{3400}-\\x{9fff}\\x{f900}-\\x{faff}\\x{3040}-\\x{30ff}]')) AS width FROM documents")
def display_width(spark, sf):
    return _docs(spark, sf).select("doc_id", text.display_width(F.col("text")).cast("long").alias("width"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{3040}-\\x{30ff}]') THEN 'ja' WHEN regexp_matches(text, '[\\x{ac00}-\\x{d7a3}]') THEN 'ko'
 WHEN regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') THEN 'zh' ELSE 'en' END AS language FROM documents""")
def detect_language(spark, sf):
    return _docs(spark, sf).select("doc_id", text.detect_language(F.col("text")).alias("language"))


@query("""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&[a-z]+;', ' ', 'g'), '\\s+', ' ', 'g'))) AS cue FROM pages""")
def strip_markup(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", F.sha2(text.clean_cue(F.col("html")), 256).alias("cue"))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages")
def page_title(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", text.page_title(F.col("html")).alias("title"))


@query("SELECT page_id, nullif(regexp_extract(url, '/(\\d+)(?:[?#]|$)', 1), '') AS ident FROM pages")
def url_ids(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", text.url_path_id(F.col("url")).alias("ident"))


SAFE = """left(regexp_replace(regexp_replace(regexp_replace({0}, '[/\\\\:*?"<>|\\x00-\\x1f]', ' ', 'g'), '\\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g'), 120)"""


@query(f"SELECT page_id, {SAFE.format('url')} AS name FROM pages")
def safe_names(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", text.safe_name(F.col("url")).alias("name"))


@query(f"""WITH p AS (SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN ' ' ELSE p_brand END AS a, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_name || ': ' || p_type || '?' END AS t, CASE WHEN p_size % 3 = 0 THEN lpad(p_partkey::VARCHAR, 11, 'x') END AS v FROM part)
SELECT id, CASE WHEN t IS NOT NULL THEN {SAFE.format("CASE WHEN trim(a) = '' THEN trim(t) ELSE trim(a) || ' - ' || trim(t) END")} || CASE WHEN v IS NULL THEN '' ELSE ' [' || v || ']' END || '.mp4' END AS name FROM p""")
def canonical_names(spark, sf):
    n = F.col("p_size")
    artist, track = F.when(n % 4 == 0, " ").otherwise(F.col("p_brand")), F.when(n % 7 != 0, F.concat("p_name", F.lit(": "), "p_type", F.lit("?")))
    ident = F.when(n % 3 == 0, F.lpad(F.col("p_partkey").cast("string"), 11, "x"))
    return A.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.canonical_name(artist, track, ident, F.lit(".mp4")).alias("name"))


@query("""WITH m AS (SELECT p_partkey AS id, ['List does not exist', 'HTTP Error 404', 'This is a PRIVATE list', 'Please sign in', 'not a bot', 'video Unavailable', '退出码 -11', 'Bus error at ', 'produced no output files', 'HTTP 503 '][p_partkey % 10 + 1] || ' ' || p_type AS m FROM part)
SELECT id, CASE WHEN regexp_matches(m, 'does not exist|404') THEN 'not found' WHEN contains(m, 'PRIVATE') THEN 'private' WHEN regexp_matches(m, 'sign in| bot') THEN 'login required' WHEN contains(m, 'Unavailable') THEN 'unavailable' ELSE 'failed: ' || left(m, 200) END AS kind,
  regexp_matches(m, '退出码 -|Bus error|no output') AS transient FROM m""")
def error_kinds(spark, sf):
    said = ["List does not exist", "HTTP Error 404", "This is a PRIVATE list", "Please sign in", "not a bot", "video Unavailable", "退出码 -11", "Bus error at ", "produced no output files", "HTTP 503 "]
    rows = A.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", F.element_at(F.array(*map(F.lit, said)), (F.col("p_partkey") % 10 + 1).cast("int")), "p_type").alias("m"))
    return rows.select("id", text.friendly_error(F.col("m")).alias("kind"), text.is_transient(F.col("m")).alias("transient"))


#: URLs that name a video, by the remainder of the key; some ids are followed by more letters.
URL_FORMS = ["https://www.youtube.com/watch?v={0}&list={0}", "https://youtu.be/{0}?t=3", "https://example.org/{0}", "https://www.youtube.com/shorts/{0}", "https://www.youtube.com/embed/{0}abc", "https://www.youtube.com/v/{0}", "https://www.youtube.com/live/{0}?list=x"]
_URL_SQL = " ".join(f"WHEN {k} THEN replace('{form}', '{{0}}', ident)" for k, form in enumerate(URL_FORMS))


@query(f"""WITH u AS (SELECT p_partkey AS id, ['PL', 'RD', 'UL', 'LL', 'WL', 'HL', 'OL'][p_partkey % 7 + 1] || lpad(p_partkey::VARCHAR, 9, 'a') AS ident FROM part),
v AS (SELECT *, CASE (id // 7) % 7 {_URL_SQL} END AS url FROM u)
SELECT id, nullif(regexp_extract(url, '(?:v=|/shorts/|youtu\\.be/|/embed/|/v/|/live/)([0-9A-Za-z_-]{{11}})', 1), '') AS video, nullif(regexp_extract(url, '[?&]list=([A-Za-z0-9_-]+)', 1), '') AS list, left(ident, 2) IN ('RD', 'UL', 'LL', 'WL') AS dynamic FROM v""")
def listing_ids(spark, sf):
    k = F.col("p_partkey")
    ident = F.concat(F.element_at(F.array(*map(F.lit, ["PL", "RD", "UL", "LL", "WL", "HL", "OL"])), (k % 7 + 1).cast("int")), F.lpad(k.cast("string"), 9, "a"))
    url = F.replace(F.element_at(F.array(*map(F.lit, URL_FORMS)), (F.floor(k / 7) % 7 + 1).cast("int")), F.lit("{0}"), F.col("ident"))
    rows = A.table(spark, sf, "part").select(k.alias("id"), k, ident.alias("ident")).withColumn("url", url)
    return rows.select("id", text.video_id(F.col("url")).alias("video"), text.playlist_id(F.col("url")).alias("list"), text.is_dynamic_playlist(F.col("ident")).alias("dynamic"))


@query("""WITH n AS (SELECT p_partkey AS id, p_name || CASE p_partkey % 5 WHEN 0 THEN ' [' || lpad(p_partkey::VARCHAR, 11, 'x') || '].mp4' WHEN 1 THEN '[' || lpad(p_partkey::VARCHAR, 6, 'x') || ']  .mkv' WHEN 2 THEN ' [short].mp4' WHEN 3 THEN ' [abcdef] live.mp4' ELSE '[no-suffix_]' END AS name FROM part)
SELECT id, nullif(regexp_extract(regexp_replace(name, '\\.[^.]+$', ''), '\\[([A-Za-z0-9_-]{6,})\\]\\s*$', 1), '') AS archived, nullif(regexp_extract(name, '\\[([A-Za-z0-9_-]{11})\\]\\.[A-Za-z0-9]+$', 1), '') AS media FROM n""")
def file_ids(spark, sf):
    k = F.col("p_partkey")
    tail = F.when(k % 5 == 0, F.concat(F.lit(" ["), F.lpad(k.cast("string"), 11, "x"), F.lit("].mp4"))).when(k % 5 == 1, F.concat(F.lit("["), F.lpad(k.cast("string"), 6, "x"), F.lit("]  .mkv")))
    name = F.concat("p_name", tail.when(k % 5 == 2, " [short].mp4").when(k % 5 == 3, " [abcdef] live.mp4").otherwise("[no-suffix_]"))
    rows = A.table(spark, sf, "part").select(k.alias("id"), name.alias("name"))
    return rows.select("id", text.archived_id(F.col("name")).alias("archived"), text.name_id(F.col("name")).alias("media"))


@query("""WITH f AS (SELECT doc_id, string_split(text, chr(10))[1] || CASE WHEN doc_id % 3 = 0 THEN ' 《 ' || source || '》' WHEN doc_id % 3 = 1 THEN '【mv】（x）' ELSE ' | bar' END AS t FROM documents),
b AS (SELECT doc_id, regexp_extract(t, '《\\s*([^《》]+?)\\s*》', 1) AS n, trim(regexp_replace(regexp_replace(t, '[\\(（\\[【『「][^)）\\]】』」]*[\\)）\\]】』」]', ' ', 'g'), '\\s+', ' ', 'g')) AS s FROM f)
SELECT doc_id, left(CASE WHEN n <> '' AND NOT contains(s, n) THEN trim(s || ' ' || n) ELSE s END, 28) AS suggestion FROM b""")
def search_suggestion(spark, sf):
    k = F.col("doc_id")
    tail = F.when(k % 3 == 0, F.concat(F.lit(" 《 "), "source", F.lit("》"))).when(k % 3 == 1, "【mv】（x）").otherwise(" | bar")
    return _docs(spark, sf).select("doc_id", text.suggestion(F.concat(F.split("text", "\n").getItem(0), tail)).alias("suggestion"))


@query("""WITH w AS (SELECT conv_id, turn, trim(text) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN contains(t, ' ') AND length(replace(t, ' ', '')) = octet_length(encode(replace(t, ' ', '')))
  THEN len([x FOR x IN regexp_split_to_array(t, '\\s+') IF x <> '']) ELSE length(regexp_replace(t, '\\s', '', 'g')) END AS n FROM w""")
def token_numbers(spark, sf):
    return A.table(spark, sf, "conversations").select("conv_id", "turn", F.size(text.tokens(F.col("text"))).cast("long").alias("n"))


FIELD = "replace({0}, ' ', '')"


def _search_sql(q: str, terms: list[str]) -> str:
    """The scoring rules as one CASE for each field and term."""

    def one(t: str) -> str:
        cases = [f"CASE WHEN {f} = '' OR NOT contains({f}, '{t}') THEN -1 WHEN {f} = '{t}' THEN {e} WHEN starts_with({f}, '{t}') THEN {e - 40} ELSE {e - 60} END" for f, e in (("t", 120), ("a", 115), ("t", 105))]
        return f"greatest({', '.join(cases)}, -1)"

    whole = "".join(terms)
    every = " AND ".join(f"{one(t)} >= 0" for t in terms)
    mean = f"CASE WHEN {every} THEN ({' + '.join(one(t) for t in terms)}) / {len(terms)}.0::DOUBLE END"
    fields = f"SELECT id, replace({WORDS.format('title')}, ' ', '') AS t, replace({WORDS.format('artist')}, ' ', '') AS a FROM catalog"
    body = f", f AS ({fields}), s AS (SELECT id, greatest({one(whole)}::DOUBLE, CASE WHEN t <> '' AND a <> '' AND '{whole}' IN (t || a, a || t) THEN 100.0::DOUBLE END, {mean}) AS relevance FROM f)"
    return sql(body + " SELECT id, relevance FROM s WHERE relevance >= 0", CATALOG)


@query(_search_sql("src1 the", ["src1", "the"]))
def search_literal(spark, sf):
    songs = A.catalog(spark, sf)
    none = F.lit(None).cast("string")
    return search.search(songs.withColumn("index", search.literal_index(F.col("title"), none, F.col("artist"))), "src1 the").select("id", "relevance")


@query(_search_sql("src1", ["src1"]))
def search_artist(spark, sf):
    songs = A.catalog(spark, sf)
    none = F.lit(None).cast("string")
    return search.search(songs.withColumn("index", search.literal_index(F.col("title"), none, F.col("artist"))), " SRC1 ").select("id", "relevance")


KEYS = f"""k AS (SELECT p_partkey AS id, regexp_replace(lower(trim(p_brand)), '{PUNCT}', '', 'g') AS artist_key, regexp_replace(lower(trim(p_name)), '{PUNCT}', '', 'g') AS track_key,
  p_retailprice AS q, p_size AS lines FROM part), g AS (SELECT *, count(*) OVER (PARTITION BY artist_key, track_key) AS group_size FROM k WHERE track_key <> '' QUALIFY group_size > 1)"""
PICKED = """, t AS (SELECT *, CASE WHEN q >= max(q) OVER (PARTITION BY artist_key, track_key) - 4 THEN 0 ELSE 1 END AS tier FROM g),
p AS (SELECT *, row_number() OVER (PARTITION BY artist_key, track_key ORDER BY tier, lines DESC, q DESC, id) AS place FROM t)"""


@query(sql(" SELECT id, artist_key, track_key, group_size FROM g", KEYS))
def duplicate_groups(spark, sf):
    return dedupe.duplicate_groups(A.versions(spark, sf)).select("id", "artist_key", "track_key", "group_size")


def _picked(spark, sf):
    return dedupe.ranked_versions(dedupe.duplicate_groups(A.versions(spark, sf)), ["artist_key", "track_key"])


@query(sql(PICKED + " SELECT id, artist_key, track_key, tier, place FROM p", KEYS))
def pick_best_version(spark, sf):
    return _picked(spark, sf).select("id", "artist_key", "track_key", "tier", "place")


@query(sql(PICKED + " SELECT count(*) FILTER (place = 1) AS groups, count(*) AS versions, count(*) FILTER (place > 1) AS dropped, coalesce(sum(lines) FILTER (place > 1), 0)::BIGINT AS freed FROM p", KEYS))
def dedupe_totals(spark, sf):
    return dedupe.totals(_picked(spark, sf), ["artist_key", "track_key"], "lines")


@query(sql(" SELECT id, artist_key, track_key FROM g WHERE (artist_key, track_key) NOT IN (SELECT (artist_key, track_key) FROM g WHERE id % 17 = 0)", KEYS))
def measurable_groups(spark, sf):
    groups = dedupe.duplicate_groups(A.versions(spark, sf)).withColumn("error", F.when(F.col("id") % 17 == 0, "unreadable"))
    return dedupe.measurable(groups).select("id", "artist_key", "track_key")


@query("SELECT p_partkey AS id, p_name AS file, p_size AS size FROM part WHERE p_partkey % 3 <> 0")
def unmeasured_versions(spark, sf):
    rows = A.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("file"), F.col("p_size").alias("size"))
    return dedupe.unmeasured(rows, rows.where("id % 3 = 0"), ["id", "file", "size"])


@query("""WITH m AS (SELECT s.p_partkey AS id, r.p_partkey AS record_id, abs(r.p_size - s.p_size)::DOUBLE AS off
  FROM part s JOIN part r ON s.p_name = r.p_name AND s.p_brand = r.p_brand AND s.p_partkey <> r.p_partkey WHERE s.p_size > 0)
SELECT id, record_id, off FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY off, record_id) = 1 AND off <= 8""")
def nearest_duration(spark, sf):
    part = A.table(spark, sf, "part")
    length, named = F.col("p_size").cast("double"), ["p_name", "p_brand"]
    songs = part.where("p_size > 0").select(F.col("p_partkey").alias("id"), *named, length.alias("duration"))
    records = part.where("p_size IS NOT NULL").select(F.col("p_partkey").alias("record_id"), *named, length.alias("record_duration"))
    return match.nearest_duration(songs, records, named, apart=True)


@query(f"""WITH k AS (SELECT p_partkey AS id, p_size::DOUBLE AS d, lower(regexp_replace(trim(p_name), '{MATCH}', '', 'g')) AS tk, lower(regexp_replace(trim(p_brand), '{MATCH}', '', 'g')) AS ak FROM part)
SELECT s.id, r.id AS record_id, abs(r.d - s.d) AS off, row_number() OVER (PARTITION BY s.id ORDER BY abs(r.d - s.d), r.id) AS place
FROM k s JOIN k r ON s.tk = r.tk AND s.ak = r.ak WHERE s.tk <> '' AND s.id % 50 = 0""")
def exact_names(spark, sf):
    part = A.table(spark, sf, "part")
    songs = part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("track"), F.col("p_brand").alias("artist"), F.col("p_size").cast("double").alias("duration"))
    records = part.select(F.col("p_partkey").alias("record_id"), F.col("p_name").alias("record_track"), F.col("p_brand").alias("record_artist"), F.col("p_size").cast("double").alias("record_duration"))
    return match.exact_names(songs, records)


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _sub(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, '(?i){_quoted(pattern)}', '{by}', 'g')"


def _trim(text: str, letters: str = r"\s") -> str:
    return _sub(text, f"^[{letters}]+|[{letters}]+$")


def _junk(text: str) -> str:
    return _trim(_sub(_sub(_sub(_sub(f"coalesce({text}, '')", titles.BIDI), titles.EMOJI, " "), titles.FILE_EXTENSION, " "), r"\s+", " "))


LOOSE = "replace(replace(lower(" + _sub(_junk("{0}").replace("{", "{{").replace("}", "}}").replace("{{0}}", "{0}"), titles.LOOSE_PUNCTUATION) + "), 'ß', 'ss'), 'ς', 'σ')"


@query(f"""WITH t AS (SELECT doc_id, {LOOSE.format("string_split(text, chr(10))[1]")} AS title FROM documents),
n AS (SELECT conv_id, {LOOSE.format("regexp_extract(text, '^[^ ]+ [^ ]+')")} AS name FROM conversations)
SELECT doc_id, conv_id FROM t JOIN n ON name <> '' AND contains(title, name)""")
def substring_match(spark, sf):
    titles_ = _docs(spark, sf).select("doc_id", F.split("text", "\n").getItem(0).alias("title"))
    names = A.table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("at"), F.regexp_extract("text", r"^[^ ]+ [^ ]+", 0).alias("name"))
    return match.contained(titles_, names, "doc_id", "title", "at", "name").select("doc_id", "at.conv_id")


@query("""WITH p AS (SELECT p_partkey AS id, p_brand AS key, length(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '', 'g')) AS n, abs(p_size - 25) AS off FROM part),
s AS (SELECT id, key, (40 + least(n, 12) - greatest(n - 12, 0) * 3 + CASE WHEN off <= 3 THEN 30 WHEN off <= 8 THEN 20 WHEN off <= 15 THEN 8 ELSE -25 END)::INTEGER AS points FROM p)
SELECT key, id, points, points >= 70 AS accepted FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY points DESC, id) = 1""")
def substring_match_score(spark, sf):
    rows = A.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("key"), F.col("p_name").alias("name"), F.abs(F.col("p_size") - 25).alias("off"))
    return match.first_best(match.containment_points(rows, "name", "off"), "key", "points", ["id"]).select("key", "id", "points", "accepted")


@query("""WITH u AS (SELECT p_brand || ' ' || p_type AS id, p_partkey AS n, CASE WHEN p_size < 17 THEN 0 WHEN p_size < 34 THEN 1 ELSE 2 END AS attempt FROM part), d AS (SELECT id, attempt, min(n) AS n FROM u GROUP BY 1, 2)
SELECT id, n, attempt FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY attempt) = 1""")
def union_first_wins(spark, sf):
    part = A.table(spark, sf, "part").select(F.concat_ws(" ", "p_brand", "p_type").alias("id"), F.col("p_partkey").alias("n"), "p_size")
    tries = [part.where("p_size < 17"), part.where("p_size >= 17 AND p_size < 34"), part.where("p_size >= 34")]
    return match.union_first([t.groupBy("id").agg(F.min("n").alias("n")) for t in tries], "id")


@query("SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN 'a:' || substr(url, 8) WHEN starts_with(url, 'https://m.') THEN 'm:' || substr(url, 11) ELSE url END AS url FROM pages")
def path_prefix(spark, sf):
    return match.path_prefix(A.table(spark, sf, "pages").select("page_id", "url"), [("http://", "a:"), ("https://m.", "m:")], "url")


@query("""SELECT l_orderkey, l_linenumber, printf('[%02d:%05.2f]', (l_partkey // 60)::INTEGER, (l_partkey % 60)::DOUBLE) AS stamp,
 (l_partkey // 60)::DOUBLE * 60 + (l_partkey % 60) AS back FROM lineitem""")
def time_stamps(spark, sf):
    stamp = clock.lrc_stamp(F.col("l_partkey").cast("double"))
    back = clock.subtitle_seconds(F.regexp_replace(stamp, r"[\[\]]", ""))
    return A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", stamp.alias("stamp"), back.alias("back"))


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '-inf'::DOUBLE ELSE 4 * p_size::DOUBLE + p_partkey::DOUBLE - 5 * (p_partkey % 3)::DOUBLE END AS q FROM part")
def quality_scores(spark, sf):
    hf = F.when(F.col("p_size") % 7 != 0, F.col("p_partkey").cast("double"))
    return A.table(spark, sf, "part").select("p_partkey", clock.quality_score(F.col("p_size").cast("double"), hf, (F.col("p_partkey") % 3).cast("double")).alias("q"))


@query("SELECT c_custkey, left(sha256(concat_ws(chr(31), 'presence', c_mktsegment, c_custkey::VARCHAR)), 16) AS ident FROM customer")
def pseudonyms(spark, sf):
    return A.table(spark, sf, "customer").select("c_custkey", clock.pseudonym(F.lit("presence"), F.col("c_mktsegment"), F.col("c_custkey").cast("string")).alias("ident"))


def _clean_title_sql(text: str) -> str:
    for pattern in (titles.NOISE, titles.PAREN_NOISE, titles.TRAILING, *[titles.TAIL_WORDS] * 4):
        text = _sub(text, pattern)
    return _trim(_trim(_sub(text, r"\s+", " "), " \\-–—|·丨｜_"))


_EDGE = " \\-–—_·,、"
# each layer of the tail goes on its own, unless nothing but edge letters would be left
_LAYERS = ", ".join(f"t{k} AS (SELECT *, CASE WHEN {_trim(_sub(f's{k - 1}', titles.TAIL_JUNK + '$'), _EDGE)} <> '' THEN {_sub(f's{k - 1}', titles.TAIL_JUNK + '$')} ELSE s{k - 1} END AS s{k} FROM t{k - 1})" for k in range(1, 5))
_NAMED = """WITH p AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS page FROM pages),
m AS (SELECT page_id, page || ['', ' (Official Video)', ' HD 完整版', ' - Official MV', '【高清】 4K', ' 海 Sea of Songs', ' • 49M plays'][page_id % 7 + 1] AS title FROM p)"""
_MADE = ["", " (Official Video)", " HD 完整版", " - Official MV", "【高清】 4K", " 海 Sea of Songs", " • 49M plays"]


@query(f"""{_NAMED}, a AS (SELECT page_id, title, {_sub(_junk('title'), '[（(][^）)]*[）)]', ' ')} AS x FROM m),
b AS (SELECT *, {_sub('x', '[【「『〖[][^】」』〗\\]]*[】」』〗\\]]', ' ')} AS y FROM a),
c AS (SELECT *, regexp_split_to_array(CASE WHEN {_trim('y', _EDGE)} <> '' THEN y ELSE x END, '\\s+[-–—]\\s+') AS z FROM b),
d AS (SELECT *, CASE WHEN len(z) > 1 AND regexp_matches(z[len(z)], '(?i){_quoted(titles.JUNK_TRACK)}') THEN array_to_string(z[1:len(z) - 1], ' ') ELSE CASE WHEN {_trim('y', _EDGE)} <> '' THEN y ELSE x END END AS e FROM c),
t0 AS (SELECT *, coalesce(nullif(regexp_extract(e, '(?i)^(.*?{titles.HAN}[^A-Za-z]*)\\s*[A-Za-z][A-Za-z''’,.\\s!?&-]*$', 1), ''), e) AS s0 FROM d), {_LAYERS},
g AS (SELECT page_id, {_sub(_junk('title'), titles.CHANNEL_STATS)} AS q FROM m),
h AS (SELECT page_id, CASE WHEN regexp_matches(q, '{titles.HAN}') THEN coalesce([x FOR x IN regexp_split_to_array({_sub('q', "[（(][A-Za-z .'’-]+[）)]", ' ')}, '\\s+[-–—]\\s+') IF regexp_matches(x, '{titles.HAN}')][1], q) ELSE q END AS r FROM g),
i AS (SELECT page_id, {_trim(_sub('r', '\\s+', ' '), _EDGE)} AS v FROM h)
SELECT page_id, {_clean_title_sql('title')} AS cleaned, {_trim(_sub('s4', '\\s+', ' '), _EDGE)} AS track, CASE WHEN regexp_matches(v, '(?i){titles.ONLY_JUNK}') THEN '' ELSE v END AS artist FROM t4 JOIN i USING (page_id)""")
def clean_tracks(spark, sf):
    return _named_pages(spark, sf).select("page_id", titles.cleaned_title(F.col("title")).alias("cleaned"), titles.cleaned_track(F.col("title")).alias("track"), titles.cleaned_artist(F.col("title")).alias("artist"))


def _named_pages(spark, sf):
    made = F.element_at(F.array(*map(F.lit, _MADE)), (F.col("page_id") % 7 + 1).cast("int"))
    return A.table(spark, sf, "pages").select("page_id", F.concat(text.page_title(F.col("html")), made).alias("title"))


#: Beginnings and ends that make a title one of each convention.
_KINDS = [("NO 12 ", " - 歌手甲(國語) 卡拉OK"), ("歌手甲 Singer 演唱《 歌 名", " 》(Official MV)"), ("《歌名", "》 x - Some Singer"), ("歌手乙 Two【", "】Official Video"), ("", "-(歌手丙 Three)-MV"), ("", "丨歌手丁丨K歌男唱版"), ("Group - ", " feat. Guest 『x』"), ("", " official mv")]


def _han_sql(x: str) -> str:
    parts = f"[trim(h) FOR h IN regexp_extract_all({x}, '[\\x{{4e00}}-\\x{{9fff}}][\\x{{4e00}}-\\x{{9fff}}·&、\\s]*')]"
    return f"coalesce(nullif(list_reduce(list_prepend('', {parts}), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END), ''), {_trim(x)})"


def _guess_sql() -> str:
    dash = "[-–—]"
    disc = f"^NO\\s*{dash}?\\s*\\d+\\s*{dash}?\\s*(.+?)\\s*{dash}\\s*([^-–—(（]{{1,20}})"
    book, bracket, paren = "(?s)^(.*?)《\\s*([^《》]+?)\\s*》(.*)$", "(?s)^(.*?)[【〖[]\\s*([^】〗\\]]+?)\\s*[】〗\\]]", f"^([^-–—]+?)\\s*{dash}\\s*[（(]\\s*([^)）]+?)\\s*[)）]"
    split = f"(?s)^(.*?)\\s*{dash}{{1,2}}\\s*(.*)$"
    g = lambda text, pattern, k: f"regexp_extract({text}, '(?i){pattern}', {k})"
    has = lambda text, pattern: f"regexp_matches({text}, '(?i){_quoted(pattern)}')"
    clean, han = _clean_title_sql, _han_sql
    places = [("ld", g("raw", disc, 1)), ("la", g("raw", disc, 2)), ("b1", g("raw", book, 1)), ("b2", g("raw", book, 2)), ("b3", g("raw", book, 3)), ("k1", g("raw", bracket, 1)), ("k2", g("raw", bracket, 2)),
              ("p1", g("raw", paren, 1)), ("p2", g("raw", paren, 2)), ("clean", clean("raw"))]
    before = _trim(_sub(_sub("b1", "[（(【[][^)）】\\]]*[)）】\\]]"), titles.BEFORE_BOOK), " \\-–—|·:：、")
    after = f"regexp_extract(b3, '{dash}\\s*([^-–—(（【[]{{1,20}})\\s*$', 1)"
    parts = "[x FOR x IN regexp_split_to_array(clean, '\\s*[丨｜|]\\s*') IF trim(x) <> '']"
    rules = [
        (has("raw", disc), clean("la"), clean("ld")),
        (has("raw", book), f"CASE WHEN before <> '' AND length(before) <= 20 THEN {han('before')} WHEN after <> '' THEN {han(clean('after'))} END", clean("b2")),
        (f"{has('raw', bracket)} AND NOT {has('k2', titles.BRACKET_NOISE)}", han(clean("k1")), clean("k2")),
        (f"{has('raw', paren)} AND NOT regexp_matches('(' || p2 || ')', '(?i)^{_quoted(titles.PAREN_NOISE)}')", han(clean("p2")), clean("p1")),
        ("regexp_matches(raw, '[丨｜|]') AND len(parts) >= 2", han("parts[2]"), "trim(parts[1])"),
        ("trim(d1) <> '' AND trim(d2) <> ''", han("d1"), "trim(d2)"),
        ("true", "NULL", "clean"),
    ]
    nth = "CASE " + " ".join(f"WHEN {when} THEN {k}" for k, (when, _, _) in enumerate(rules)) + " END"
    pick = lambda k: "CASE nth " + " ".join(f"WHEN {n} THEN {r[k]}" for n, r in enumerate(rules)) + " END"
    kinds = " ".join(f"WHEN {k} THEN '{a}' || page || '{b}'" for k, (a, b) in enumerate(_KINDS))
    track = _trim(_sub(_sub(_sub("t", titles.FEATURED), "[『「〖][^』」〗]*[』」〗]"), "\\s+", " "), " \\-–—|·")
    artist = _trim(han(_sub("a", "[『「【〖[][^』」】〗\\]]*[』」】〗\\]]")), " \\-–—|·、")
    return f"""WITH p AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS page FROM pages),
m AS (SELECT page_id, {_trim(f"CASE page_id % {len(_KINDS)} {kinds} END")} AS raw FROM p),
g AS (SELECT *, {", ".join(f"{x} AS {n}" for n, x in places)} FROM m),
h AS (SELECT *, {before} AS before, {after} AS after, {parts} AS parts, {g('clean', split, 1)} AS d1, {g('clean', split, 2)} AS d2 FROM g),
n AS (SELECT *, {nth} AS nth FROM h), f AS (SELECT page_id, nullif({pick(1)}, '') AS a, nullif({pick(2)}, '') AS t FROM n)
SELECT page_id, nullif(CASE WHEN a IS NOT NULL THEN {artist} END, '') AS guessed_artist, nullif({track}, '') AS guessed_track FROM f"""


@query(_guess_sql())
def guess_meta(spark, sf):
    none, kind = F.lit(None).cast("string"), F.col("page_id") % len(_KINDS)
    page, made = text.page_title(F.col("html")), F.lit("")
    for k, (a, b) in enumerate(_KINDS):
        made = F.when(kind == k, F.concat(F.lit(a), page, F.lit(b))).otherwise(made)
    rows = A.table(spark, sf, "pages").select("page_id", made.alias("title"), none.alias("artist"), none.alias("track"))
    return titles.with_guess(rows).select("page_id", "guessed_artist", "guessed_track")


@query()
def title_queries(spark, sf):
    none = F.lit(None).cast("string")
    named = titles.with_guess(_named_pages(spark, sf).withColumns({"artist": none, "track": none}))
    return named.select("page_id", titles.search_queries(F.col("title"), F.col("guessed_artist"), F.col("guessed_track")).alias("queries"))


@query()
def fix_plans(spark, sf):
    part, none = A.table(spark, sf, "part"), F.lit(None).cast("string")
    named = F.concat_ws(" - ", "p_brand", "p_name")
    title = F.when(F.col("p_size") % 3 == 0, F.concat(named, F.lit(" Official MV"))).otherwise(named)
    # answers to the first query name the track with its brand's own and others' lengths, to the second also other tracks of the brand
    by = {"n": "p_name"} | ({"c": "p_container"} if "p_container" in part.columns else {})
    asked = {k: F.concat(F.lit(k), "p_brand", F.lit("\n"), c) for k, c in by.items()}
    jobs = part.select(F.col("p_partkey").alias("id"), title.alias("title"), F.when(F.col("p_size") % 5 == 0, F.col("p_brand")).alias("artist"), F.when(F.col("p_size") % 5 == 0, named).alias("track"), F.col("p_size").cast("double").alias("duration"), F.array(asked["n"], asked.get("c", asked["n"])).alias("queries"))
    artist = F.when(F.col("p_partkey") % 4 == 0, F.concat("p_brand", F.lit(" Records"))).otherwise(F.col("p_brand"))
    record = (F.col("p_partkey").alias("cand_no"), F.col("p_name").alias("trackName"), artist.alias("artistName"), F.col("p_size").cast("double").alias("duration"), (F.col("p_partkey") % 2 == 0).alias("synced"), (F.col("p_partkey") % 3 == 0).alias("instrumental"))
    answers = part.select(F.explode(F.array(*asked.values())).alias("asked"), *record)
    return titles.shared_plans(jobs, answers)
