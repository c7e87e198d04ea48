"""Queries of timed text, signals and imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessitura.functions.clock import editor_time
from tessitura.operators import imports, signal, timed
from tessitura.sources import adapters as A

from .tables import CATALOG, FILLED, LINES, sql

QUERIES, SQL = {}, {}


def query(body: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if body:
            SQL[function.__name__] = body
        return function

    return add


def _filled(spark, sf):
    return timed.fill_ends(A.lines(spark, sf))


@query(sql(" SELECT job_id, line_no, start_ms, end_ms FROM filled", FILLED))
def lead_fill_ends(spark, sf):
    return _filled(spark, sf).select("job_id", "line_no", "start_ms", "end_ms")


@query(sql(""", c AS (SELECT *, CASE WHEN singer IS NOT DISTINCT FROM lag(singer) OVER w AND lag(1) OVER w IS NOT NULL THEN 0 ELSE 1 END AS c FROM filled WINDOW w AS (PARTITION BY job_id ORDER BY line_no)),
r AS (SELECT *, sum(c) OVER (PARTITION BY job_id ORDER BY line_no) AS run FROM c)
SELECT job_id, min(line_no) AS line_no, min(singer) AS singer, min(start_ms) AS start_ms, arg_max(end_ms, line_no) AS end_ms, count(*) AS merged FROM r GROUP BY job_id, run""", FILLED))
def merge_adjacent(spark, sf):
    return timed.merge_adjacent(_filled(spark, sf), "singer")


@query(sql(""", d AS (SELECT job_id, max(start_ms) + 2000 AS duration FROM filled GROUP BY 1),
g AS (SELECT f.job_id, line_no, text, start_ms AS s, CASE WHEN line_no % 5 = 2 THEN start_ms ELSE end_ms - 500 END AS e0, lag(start_ms) OVER w AS p, lead(start_ms) OVER w AS n, duration
  FROM filled f JOIN d ON f.job_id = d.job_id WINDOW w AS (PARTITION BY f.job_id ORDER BY line_no)),
h AS (SELECT *, CASE WHEN e0 <= s THEN s + 500 ELSE e0 END AS e FROM g),
k AS (SELECT *, greatest(0, CASE WHEN p IS NULL THEN s - 600 ELSE greatest(s - 600, (p + s) / 2) END)::DOUBLE AS from_ms, (CASE WHEN n IS NULL THEN e + 600 ELSE least(e + 600, (e + n) / 2) END)::DOUBLE AS hi FROM h)
SELECT job_id, line_no, from_ms, least(duration::DOUBLE, greatest(hi, from_ms + 500)) AS to_ms FROM k WHERE trim(text) <> ''""", FILLED))
def align_windows(spark, sf):
    rows = _filled(spark, sf).withColumn("end_ms", F.when(F.col("line_no") % 5 == 2, F.col("start_ms")).otherwise(F.col("end_ms") - 500))
    rows = rows.join(rows.groupBy("job_id").agg((F.max("start_ms") + 2000).alias("duration_ms")), "job_id")
    return timed.alignment_windows(rows).select("job_id", "line_no", "from_ms", "to_ms")


@query(sql(""", x AS (SELECT job_id, line_no, CASE WHEN line_no % 7 = 3 THEN start_ms - 90000 ELSE start_ms END AS s, end_ms AS e FROM filled),
b AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY job_id ORDER BY line_no) > s, false) OR s < 0 OR e < s AS bad FROM x)
SELECT job_id, count(*) AS lines, count(*) FILTER (bad) AS bad, count(*) FILTER (bad) = 0 AS valid FROM b GROUP BY 1""", FILLED))
def monotonic_check(spark, sf):
    rows = _filled(spark, sf).withColumn("start_ms", F.when(F.col("line_no") % 7 == 3, F.col("start_ms") - 90000).otherwise(F.col("start_ms")))
    return timed.monotonic(rows)


@query(sql(" SELECT job_id, line_no, coalesce(start_ms >= 0 AND end_ms >= start_ms AND end_ms <= 60000 + 1, false) AS valid FROM filled", FILLED))
def editor_check(spark, sf):
    return timed.valid_for_editor(_filled(spark, sf).withColumn("duration_ms", F.lit(60000)), "duration_ms").select("job_id", "line_no", "valid")


@query(sql(""", t AS (SELECT job_id, line_no, start_ms, end_ms, [x FOR x IN string_split(text, ' ') IF x <> ''] AS ws FROM filled),
u AS (SELECT *, unnest(range(0, len(ws))) AS k FROM t)
SELECT job_id, line_no, k AS item_no, ws[k + 1] AS item, (start_ms + floor((end_ms - start_ms) * k / len(ws)))::BIGINT AS item_start_ms,
       (start_ms + floor((end_ms - start_ms) * (k + 1) / len(ws)))::BIGINT AS item_end_ms FROM u""", FILLED))
def even_spread(spark, sf):
    rows = _filled(spark, sf).select("job_id", "line_no", "start_ms", "end_ms", F.array_remove(F.split("text", " "), "").alias("ws"))
    return timed.even_spread(rows, "ws", "start_ms", "end_ms").drop("ws", "start_ms", "end_ms")


@query(sql(""", s AS (SELECT job_id, min(start_ms) AS s, max(end_ms) AS e FROM filled GROUP BY 1),
w AS (SELECT job_id, line_no, length(text) AS w, s, e, sum(length(text)) OVER (PARTITION BY job_id) AS total,
  coalesce(sum(length(text)) OVER (PARTITION BY job_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM filled JOIN s USING (job_id))
SELECT job_id, line_no, (s + floor((e - s) * before / greatest(total, 1)))::BIGINT AS piece_start_ms, least(e, s + floor((e - s) * (before + w) / greatest(total, 1)))::BIGINT AS piece_end_ms FROM w""", FILLED))
def proportional_spread(spark, sf):
    rows = _filled(spark, sf)
    span = rows.groupBy("job_id").agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e"))
    pieces = rows.select("job_id", "line_no", F.length("text").alias("w")).join(span, "job_id")
    return timed.proportional_spread(pieces, "w", "s", "e", ["job_id"], "line_no").select("job_id", "line_no", "piece_start_ms", "piece_end_ms")


@query(sql(""", p AS (SELECT event_id, user_id AS job_id, round(value * 200)::BIGINT AS t FROM events)
SELECT event_id, p.job_id, t, l.line_no AS line_line_no, l.singer AS line_singer FROM p ASOF LEFT JOIN (SELECT *, start_ms - 20 AS s FROM lines) l ON p.job_id = l.job_id AND p.t >= l.s""", LINES))
def asof_line(spark, sf):
    probes = A.table(spark, sf, "events").select("event_id", F.col("user_id").alias("job_id"), F.round(F.col("value") * 200).cast("long").alias("t"))
    return timed.asof(probes, A.lines(spark, sf), "job_id", "t", "start_ms", ["line_no", "singer"])


@query(sql(" SELECT job_id, line_no, greatest(0, start_ms - 2500)::BIGINT AS start_ms, greatest(0, end_ms - 2500)::BIGINT AS end_ms FROM filled", FILLED))
def shift_track(spark, sf):
    return timed.shift(_filled(spark, sf).select("job_id", "line_no", "start_ms", "end_ms"), -2500)


@query(sql(" SELECT job_id, line_no, trim(text) AS text, (row_number() OVER (PARTITION BY job_id ORDER BY start_ms, line_no) - 1) AS place FROM filled WHERE trim(text) <> ''", FILLED))
def normalized_edit(spark, sf):
    rows = _filled(spark, sf).withColumn("old", F.col("line_no"))
    return timed.normalized_edit(rows).select("job_id", F.col("old").alias("line_no"), "text", F.col("line_no").alias("place"))


@query(sql(" SELECT job_id, line_no, start_ms, end_ms FROM filled WHERE end_ms >= start_ms", FILLED))
def stage_lines(spark, sf):
    return timed.stage_lines(_filled(spark, sf)).select("job_id", "line_no", "start_ms", "end_ms")


@query(sql(" SELECT job_id, line_no, printf('%02d:%02d.%03d', start_ms // 60000, (start_ms // 1000) % 60, start_ms % 1000) AS shown FROM lines", LINES))
def editor_times(spark, sf):
    return A.lines(spark, sf).select("job_id", "line_no", editor_time(F.col("start_ms")).alias("shown"))


def _in_seconds(spark, sf, words=False):
    rows = _filled(spark, sf)
    own = F.array().cast("array<struct<text:string,start:double,end:double>>")
    if words:  # each token starts a tenth after the one before; ends are left open
        own = F.transform(F.array_remove(F.split("text", " "), ""), lambda w, k: F.struct(w.alias("text"), F.when(k % 3 != 1, F.col("start_ms") / 1000.0 + k / 10.0).alias("start"), F.lit(None).cast("double").alias("end")))
    return rows.select("job_id", "line_no", (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), F.regexp_replace("text", "\n", " ").alias("text"), own.alias("words"))


def _rounded(x: str) -> str:
    """Milliseconds of a double by its exact value, as printing it rounds."""
    return f"printf('%.3f', {x})::DOUBLE"


FILL = "WITH RECURSIVE " + FILLED + f""", t AS (SELECT job_id, line_no, start_ms / 1000.0::DOUBLE AS s, end_ms / 1000.0::DOUBLE AS e, [x FOR x IN string_split(text, ' ') IF x <> ''] AS ws FROM filled),
l AS (SELECT *, len(ws) AS n, CASE WHEN e > s THEN e ELSE s + greatest(0.1 * len(ws), 0.3) END AS last FROM t WHERE len(ws) > 0),
w AS (SELECT job_id, line_no, n, last, unnest(range(0, n)) AS k, unnest(ws) AS text, s AS line_start FROM l),
v AS (SELECT *, CASE WHEN k % 3 <> 1 THEN line_start + k / 10.0::DOUBLE END AS start, min(CASE WHEN k % 3 <> 1 THEN line_start + k / 10.0::DOUBLE END) OVER (PARTITION BY job_id, line_no ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM w),
f AS (
  SELECT job_id, line_no, k, {_rounded('b')} AS start, {_rounded('d')} AS finish FROM (SELECT *, start AS b, CASE WHEN later > start THEN later ELSE start + greatest((last - start) / n, 0.15) END AS d FROM v WHERE k = 0)
  UNION ALL
  SELECT job_id, line_no, k, {_rounded('b')}, {_rounded('d')}
  FROM (SELECT *, CASE WHEN later > b THEN later ELSE b + greatest((last - b) / (n - k), 0.15) END AS d
        FROM (SELECT v.job_id, v.line_no, v.k, v.n, v.last, v.later, coalesce(v.start, f.finish) AS b FROM f JOIN v ON v.job_id = f.job_id AND v.line_no = f.line_no AND v.k = f.k + 1)))
SELECT f.job_id, f.line_no, f.k AS word_no, trim(v.text, E' \\t\\n\\r') AS word, f.start, f.finish FROM f JOIN v USING (job_id, line_no, k)"""


@query(FILL)
def interpolate_words(spark, sf):
    each = timed.interpolate_words(_in_seconds(spark, sf, words=True)).select("job_id", "line_no", F.posexplode("words").alias("word_no", "w"))
    return each.select("job_id", "line_no", F.col("word_no").cast("long").alias("word_no"), F.col("w.text").alias("word"), F.col("w.start").alias("start"), F.col("w.end").alias("finish"))


@query()
def split_lines(spark, sf):
    return timed.split_lines(timed.interpolate_words(_in_seconds(spark, sf, words=True)))


@query()
def split_plain_lines(spark, sf):
    return timed.split_lines(_in_seconds(spark, sf)).drop("words")


@query()
def widths_after_split(spark, sf):
    return timed.widths(_in_seconds(spark, sf))


SMOOTH = """e AS (SELECT vec_id, unnest(range(0, len(embedding))) AS bin, unnest(embedding)::DOUBLE AS v FROM embeddings)"""


@query(f"WITH {SMOOTH} SELECT vec_id, bin, round(sum(v) OVER (PARTITION BY vec_id ORDER BY bin ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9.0, 6) + 0.0 AS smooth FROM e")
def moving_average(spark, sf):
    each = A.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("bin", "v")).select("vec_id", F.col("bin").cast("long").alias("bin"), F.col("v").cast("double").alias("v"))
    return signal.moving_average(each, "vec_id", "bin", "v").select("vec_id", "bin", (F.round("smooth", 6) + 0.0).alias("smooth"))


@query(f"""WITH {SMOOTH.replace('vec_id,', 'label,')}, p AS (SELECT label, bin, sum(v * v) / count(*) AS power FROM e GROUP BY 1, 2),
d AS (SELECT label, bin, 10 * log10(power + 1e-20) AS db FROM p),
s AS (SELECT label, bin, sum(db) OVER (PARTITION BY label ORDER BY bin ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9.0 AS smooth FROM d),
r AS (SELECT *, avg(smooth) FILTER (bin BETWEEN 8 AND 24) OVER (PARTITION BY label) AS ref FROM s)
SELECT label, round(min(ref), 6) AS ref_db, max(bin) FILTER (smooth > ref - 1.0) AS cutoff_bin, round(avg(smooth) FILTER (bin BETWEEN 40 AND 60) - min(ref), 6) AS high_db FROM r GROUP BY 1""")
def spectrum_metrics(spark, sf):
    power = signal.mean_spectrum(A.table(spark, sf, "embeddings").select("label", "embedding"), "label", "embedding")
    return _rounded(signal.spectrum_metrics(power, "label", (8, 24), (40, 60), 1.0), "label")


def _rounded(metrics, key):
    return metrics.select(key, F.round("ref_db", 6).alias("ref_db"), F.col("cutoff_bin").cast("long").alias("cutoff_bin"), F.round("high_db", 6).alias("high_db"))


@query("""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS bin, CASE WHEN unnest(embedding) > 0.05 THEN unnest(embedding)::DOUBLE * unnest(embedding)::DOUBLE ELSE 0 END AS power FROM embeddings),
s AS (SELECT vec_id, bin, sum(10 * log10(power + 1e-20)) OVER (PARTITION BY vec_id ORDER BY bin ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9.0 AS smooth FROM e),
r AS (SELECT *, avg(smooth) FILTER (bin BETWEEN 8 AND 24) OVER (PARTITION BY vec_id) AS ref FROM s)
SELECT vec_id, round(min(ref), 6) AS ref_db, max(bin) FILTER (smooth > ref - 30.0) AS cutoff_bin, round(avg(smooth) FILTER (bin BETWEEN 40 AND 60) - min(ref), 6) AS high_db FROM r GROUP BY 1""")
def silent_spectrum(spark, sf):
    loud = F.transform("embedding", lambda x: F.when(x > 0.05, x.cast("double") * x.cast("double")).otherwise(F.lit(0.0)))
    power = A.table(spark, sf, "embeddings").select("vec_id", F.posexplode(loud).alias("bin", "power"))
    return _rounded(signal.spectrum_metrics(power, "vec_id", (8, 24), (40, 60)), "vec_id")


@query("""WITH e AS (SELECT vec_id, unnest(embedding) * 6 AS x FROM embeddings)
SELECT vec_id, round(20 * log10(sqrt(avg(x::DOUBLE * x::DOUBLE)) + 1e-12), 6) AS rms_db, 100.0::DOUBLE * count(*) FILTER (abs(x) > 0.985) / count(*) AS clip_pct FROM e GROUP BY 1""")
def clipped_loudness(spark, sf):
    loud = signal.loudness(F.transform("embedding", lambda x: (x * 6).cast("float")))
    rows = A.table(spark, sf, "embeddings").select("vec_id", loud.alias("l"))
    return rows.select("vec_id", F.round("l.rms_db", 6).alias("rms_db"), "l.clip_pct")


#: A rule of the size of the test vectors: bins 2 to 40.
RULE = signal.Howl(min_hz=2, max_hz=40, over_median=0.2, harmonic=0.1, quiet=0.15, frames=2, near=6)
PEAKS = """e AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS s FROM embeddings),
b AS (SELECT vec_id, label, s, list_sort(s[3:41]) AS v FROM e),
p AS (SELECT vec_id, label, s, v[len(v)] AS db, v[len(v) // 2 + 1] AS median, 1 + list_position(s[3:41], v[len(v)]) AS bin FROM b),
h AS (SELECT *, (CASE WHEN bin * 2 + 1 <= 40 AND list_max(s[bin * 2 : bin * 2 + 2]) - median >= 0.1 THEN 1 ELSE 0 END) + (CASE WHEN bin * 3 + 1 <= 40 AND list_max(s[bin * 3 : bin * 3 + 2]) - median >= 0.1 THEN 1 ELSE 0 END) AS heard FROM p),
peaks AS (SELECT vec_id, label, bin::INTEGER AS bin, db, db - median AS prominence FROM h WHERE db >= 0.15 AND db - median >= 0.2 AND heard < 2)"""


def _peaks(spark, sf):
    return A.table(spark, sf, "embeddings").select("label", "vec_id", signal.peak(F.col("embedding").cast("array<double>"), 1.0, RULE).alias("p"))


@query(sql(" SELECT vec_id, bin, bin::DOUBLE AS hz, db, prominence FROM peaks", PEAKS))
def howl_peak(spark, sf):
    return _peaks(spark, sf).where("p IS NOT NULL").select("vec_id", "p.*")


@query("WITH RECURSIVE " + PEAKS + """, f AS (SELECT e.label, e.vec_id AS frame, bin, db, row_number() OVER (PARTITION BY e.label ORDER BY e.vec_id) AS n FROM e LEFT JOIN peaks USING (vec_id)),
r AS (
  SELECT label, n, frame, bin, db, bin AS began, CASE WHEN bin IS NULL THEN 0 ELSE 1 END AS hits, false AS told FROM f WHERE n = 1
  UNION ALL
  SELECT label, n, frame, bin, db, CASE WHEN bin IS NULL THEN NULL WHEN near THEN began ELSE bin END, CASE WHEN bin IS NULL OR tell THEN 0 ELSE h END, tell
  FROM (SELECT *, bin IS NOT NULL AND h >= 2 AND (before IS NULL OR db > before - 1) AS tell
        FROM (SELECT f.label, f.n, f.frame, f.bin, f.db, r.began, r.db AS before, coalesce(abs(f.bin - r.began) <= 6, false) AS near, CASE WHEN coalesce(abs(f.bin - r.began) <= 6, false) THEN r.hits + 1 ELSE 1 END AS h
              FROM r JOIN f ON f.label = r.label AND f.n = r.n + 1)))
SELECT label, frame, bin, db FROM r WHERE told""")
def howl_runs(spark, sf):
    rows = _peaks(spark, sf).select("label", F.col("vec_id").alias("frame"), "p.bin", "p.db")
    return signal.confirmed_runs(rows, "label", "frame", RULE)


JOBS = """jobs AS (SELECT id, CASE WHEN id % 23 = 0 THEN '' ELSE (id % 97)::VARCHAR END AS video, CASE WHEN id % 19 = 0 THEN '' ELSE (id % 71)::VARCHAR END AS path,
  CASE WHEN id % 13 = 0 THEN 'error' WHEN id % 5 = 0 THEN 'queued' WHEN id % 7 = 1 THEN 'running' WHEN id % 11 = 2 THEN 'pending' ELSE state END AS state, id % 31 AS created_at FROM catalog),
entries AS (SELECT doc_id AS entry, CASE WHEN doc_id % 29 = 0 THEN '' ELSE (doc_id % 130)::VARCHAR END AS video, CASE WHEN doc_id % 37 = 0 THEN '' ELSE (doc_id % 80)::VARCHAR END AS path,
  n_chars / 10.0::DOUBLE AS duration, doc_id % 41 = 0 AS unavailable FROM documents),
latest AS (SELECT video, id AS job_id, state AS job_state FROM jobs WHERE video <> '' QUALIFY row_number() OVER (PARTITION BY video ORDER BY created_at DESC, id DESC) = 1),
status AS (SELECT entry, job_id, CASE WHEN unavailable THEN 'unavailable' WHEN duration > 900 THEN 'too_long' WHEN job_state IS NULL THEN 'new' WHEN job_state = 'done' THEN 'done'
  WHEN job_state IN ('queued', 'running') THEN 'pending' ELSE 'failed' END AS status FROM entries LEFT JOIN latest USING (video))"""


def _listing(spark, sf):
    k = F.col("id")
    state = F.when(k % 13 == 0, "error").when(k % 5 == 0, "queued").when(k % 7 == 1, "running").when(k % 11 == 2, "pending").otherwise(F.col("state"))
    some = lambda no, n, blank: F.when(no % blank == 0, "").otherwise((no % n).cast("string"))
    jobs = A.catalog(spark, sf).select("id", some(k, 97, 23).alias("video_id"), some(k, 71, 19).alias("local_path"), state.alias("state"), (k % 31).alias("created_at"))
    d = F.col("doc_id")
    entries = A.table(spark, sf, "documents").select(d.alias("entry"), some(d, 130, 29).alias("video_id"), some(d, 80, 37).alias("path"), (F.col("n_chars") / 10.0).alias("duration"), (d % 41 == 0).alias("unavailable"))
    return entries, jobs


@query(sql(" SELECT entry, job_id, status FROM status", CATALOG, JOBS))
def import_status(spark, sf):
    return imports.listing_status(*_listing(spark, sf)).select("entry", "job_id", "status")


@query(sql(" SELECT entry, status AS reason FROM status WHERE status NOT IN ('new', 'failed')", CATALOG, JOBS))
def skipped_entries(spark, sf):
    return imports.skipped(imports.listing_status(*_listing(spark, sf))).select("entry", "reason")


@query(sql(" SELECT status, count(*) AS n FROM status GROUP BY 1", CATALOG, JOBS))
def import_summary(spark, sf):
    return imports.summary(imports.listing_status(*_listing(spark, sf)))


@query(sql(" SELECT entry FROM status WHERE status IN ('new', 'failed')", CATALOG, JOBS))
def importable_entries(spark, sf):
    return imports.importable(imports.listing_status(*_listing(spark, sf))).select("entry")


@query(sql(""", bp AS (SELECT path, id AS job_id, state AS path_state FROM jobs WHERE path <> '' QUALIFY row_number() OVER (PARTITION BY path ORDER BY created_at DESC, id DESC) = 1)
SELECT entry, coalesce(l.job_id, bp.job_id) AS job_id, CASE coalesce(l.job_state, bp.path_state, 'none') WHEN 'none' THEN 'new' WHEN 'done' THEN 'done' WHEN 'queued' THEN 'pending' WHEN 'running' THEN 'pending' ELSE 'failed' END AS status
FROM entries LEFT JOIN latest l USING (video) LEFT JOIN bp USING (path)""", CATALOG, JOBS))
def local_status(spark, sf):
    entries, jobs = _listing(spark, sf)
    return imports.local_status(entries, jobs).select("entry", "job_id", "status")


LIVE = """, live AS (SELECT * FROM jobs WHERE state IN ('pending', 'queued', 'running', 'done')),
m AS (SELECT entry, id, created_at FROM entries JOIN live ON entries.video = live.video AND live.video <> '' UNION ALL SELECT entry, id, created_at FROM entries JOIN live ON entries.path = live.path AND live.path <> '')"""


def _requests(spark, sf):
    entries, jobs = _listing(spark, sf)
    return imports.create_or_reuse(entries.select(F.col("entry").alias("request_id"), "video_id", "path"), jobs)


@query(sql(LIVE + " SELECT entry AS request_id, id AS job_id FROM m QUALIFY row_number() OVER (PARTITION BY entry ORDER BY created_at DESC, id DESC) = 1", CATALOG, JOBS))
def reused_jobs(spark, sf):
    return _requests(spark, sf)[1]


@query(sql(LIVE + " SELECT entry AS request_id FROM entries WHERE entry NOT IN (SELECT entry FROM m)", CATALOG, JOBS))
def new_jobs(spark, sf):
    return _requests(spark, sf)[0].select("request_id")


@query(sql(" SELECT video::VARCHAR AS video_id, min(entry) AS entry FROM entries GROUP BY 1", CATALOG, JOBS))
def distinct_entries(spark, sf):
    return imports.distinct_entries(_listing(spark, sf)[0].select("video_id", "entry"), "video_id", "entry")


@query("""WITH f AS (SELECT p_partkey AS id, CASE WHEN p_size <= 45 THEN p_name || ' ' || (p_partkey % 40) END AS path, CASE WHEN p_partkey % 31 <> 0 THEN p_name || ' ' || (p_partkey % 25) END AS target FROM part),
p AS (SELECT DISTINCT path FROM f WHERE path IS NOT NULL)
SELECT id, CASE WHEN f.path IS NULL THEN 'missing' WHEN target IS NULL OR f.path = target THEN 'same' WHEN p.path IS NOT NULL THEN 'clash' ELSE 'renamed' END AS plan
FROM f LEFT JOIN p ON p.path = f.target""")
def rename_plan(spark, sf):
    k = F.col("p_partkey")
    to = lambda n: F.concat_ws(" ", "p_name", (k % n).cast("string"))
    files = A.table(spark, sf, "part").select(k.alias("id"), F.when(F.col("p_size") <= 45, to(40)).alias("path"), F.when(k % 31 != 0, to(25)).alias("target"))
    return imports.rename_plan(files).select("id", "plan")


@query("""WITH d AS (SELECT l_orderkey AS task_id, l_linenumber AS role, l_partkey AS size FROM lineitem),
o AS (SELECT task_id, role, count(*) AS times, min(size) AS size FROM d GROUP BY 1, 2),
e AS (SELECT DISTINCT task_id, role FROM d WHERE role <= 6), m AS (SELECT task_id, role, times, e.role IS NOT NULL AS wanted, CASE WHEN role % 5 = 0 THEN size + 1 ELSE size END AS has, size FROM o LEFT JOIN e USING (task_id, role)),
f AS (SELECT task_id, times = 1 AND wanted AND size = has AS ok FROM m)
SELECT task_id, bool_and(ok) AS ok, count(*) FILTER (NOT ok) AS problems FROM f GROUP BY 1""")
def manifest_check(spark, sf):
    rows = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("role"), F.col("l_partkey").alias("size"), F.lit("x").alias("sha256"))
    one = rows.groupBy("task_id", "role").agg(F.min("size").alias("size"), F.first("sha256").alias("sha256"))
    stored = one.withColumn("size", F.when(F.col("role") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return imports.manifest_check(rows, one.where("role <= 6"), stored)


@query("SELECT l_orderkey AS task_id, max(l_quantity) - min(l_quantity) <= greatest(0.25, max(l_quantity) * 0.01) AS ok FROM lineitem GROUP BY 1")
def stems_agree(spark, sf):
    return imports.stems_agree(A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_quantity").alias("duration")))
