"""Queries of rooms, devices, settings, jobs, trials and playback evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessitura.operators import claims, jobs, rooms, settings
from tessitura.sources import adapters as A
from tessitura.streaming import evidence
from tessitura.streaming import rooms as room_stream

from .tables import BEATS, sql

QUERIES, SQL = {}, {}


def query(body: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if body:
            SQL[function.__name__] = body
        return function

    return add


def _events(spark, sf):
    return A.table(spark, sf, "events")


PRESENCE = """presence AS (SELECT user_id % 40 AS room_id, user_id AS member_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS device_id, (event_id % 9)::VARCHAR AS client_id,
  event_id AS ord, epoch_us(ts)::DOUBLE / 1e6 AS seen_at, CASE WHEN event_id % 2 = 0 THEN 'player' ELSE event_type END AS role, 'L' || event_id AS label FROM events)"""


def _presence(spark, sf):
    role = F.when(F.col("event_id") % 2 == 0, "player").otherwise(F.col("event_type"))
    return _events(spark, sf).select(
        (F.col("user_id") % 40).alias("room_id"), F.col("user_id").alias("member_id"), F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("event_type")).alias("device_id"),
        (F.col("event_id") % 9).cast("string").alias("client_id"), F.col("event_id").alias("order"), A.seconds().alias("seen_at"), F.array(role).alias("roles"), F.concat(F.lit("L"), F.col("event_id").cast("string")).alias("label"),
    )


@query(sql(""" SELECT room_id, member_id, coalesce(nullif(device_id, ''), 'client:' || client_id) AS device_key, min(ord) AS first_order, string_agg(DISTINCT role, ',' ORDER BY role) AS roles,
  arg_max(label, (seen_at, client_id)) AS label, max(seen_at) AS seen_at FROM presence GROUP BY 1, 2, 3""", PRESENCE))
def device_rollup(spark, sf):
    rows = rooms.device_rollup(_presence(spark, sf))
    return rows.select("room_id", "member_id", "device_key", F.col("order").alias("first_order"), F.concat_ws(",", "roles").alias("roles"), "label", "seen_at")


NOW = 1706000000.0


@query(f"""WITH m AS (SELECT user_id % 40 AS room_id, user_id, max(epoch_us(ts)::DOUBLE / 1e6) AS seen, user_id % 3 = 0 AS screen FROM events GROUP BY 2, 4, 1),
r AS (SELECT DISTINCT user_id % 50 AS room_id FROM events), c AS (SELECT room_id, count(*) FILTER ({NOW} - seen < 30 AND NOT screen) AS mo, count(*) FILTER ({NOW} - seen < 30 AND screen) AS so FROM m GROUP BY 1)
SELECT room_id, coalesce(mo, 0) AS members_online, coalesce(so, 0) AS screens_online, (room_id % 4)::INTEGER AS queued FROM r LEFT JOIN c USING (room_id)""")
def room_directory(spark, sf):
    members = _events(spark, sf).groupBy("user_id").agg(F.max(A.seconds()).alias("seen_at")).select((F.col("user_id") % 40).alias("room_id"), "seen_at", F.when(F.col("user_id") % 3 == 0, "screen").otherwise("singer").alias("role"))
    every = _events(spark, sf).select((F.col("user_id") % 50).alias("room_id")).distinct()
    return rooms.directory(every.withColumn("queue", F.slice(F.array(*map(F.lit, "abc")), F.lit(1), (F.col("room_id") % 4).cast("int"))), members, NOW)


@query("""WITH a AS (SELECT event_id, user_id, event_type = 'error' AS failed, epoch_us(date_trunc('minute', ts)) // 1000 AS at FROM events)
SELECT a.event_id, count(b.event_id) AS recent, count(b.event_id) >= 3 AS refused
FROM a LEFT JOIN a b ON a.user_id = b.user_id AND b.failed AND (b.at < a.at OR b.at = a.at AND b.event_id < a.event_id) AND a.at - b.at < 86400000 GROUP BY 1""")
def rate_limit_window(spark, sf):
    at = F.unix_millis(F.date_trunc("minute", F.col("ts").cast("timestamp")))
    rows = _events(spark, sf).select("event_id", F.col("user_id").alias("key"), at.alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"))
    return rooms.failures_in_window(rows, 86_400_000, 3).select("event_id", "recent", "refused")


@query("""SELECT event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER w OR (event_id % 3) IS DISTINCT FROM lag(event_id % 3) OVER w OR lag(event_id) OVER w IS NULL""")
def progress_changes(spark, sf):
    rows = _events(spark, sf).select("event_id", F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).alias("pct"), F.col("event_type").alias("message"))
    return rooms.changed_progress(rows).select("event_id")


@query("SELECT user_id AS task_id, event_type AS worker_id, min(event_id) AS first_seq, count(*) - 1 AS repeats FROM events GROUP BY 1, 2")
def idempotent_receipts(spark, sf):
    rows = _events(spark, sf).select(F.col("user_id").alias("task_id"), F.col("event_type").alias("worker_id"), F.lit("t").alias("claim_token"), F.col("event_id").alias("seq"), F.col("event_id").alias("first_seq"))
    return rooms.receipts(rows).select("task_id", "worker_id", "first_seq", "repeats")


TASKS = """tasks AS (SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'O' THEN 'waiting' WHEN 'F' THEN 'running' ELSE 'done' END AS state, o_custkey AS worker_id, o_orderkey % 7 AS attempts,
  o_orderkey % 100 AS lease_expires, o_orderpriority AS kind, o_orderkey % 1000 AS created_at FROM orders)"""


def _tasks(spark, sf):
    state = F.when(F.col("o_orderstatus") == "O", "waiting").when(F.col("o_orderstatus") == "F", "running").otherwise("done")
    return A.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("task_id"), state.alias("state"), F.col("o_custkey").alias("worker_id"), (F.col("o_orderkey") % 7).alias("attempts"), (F.col("o_orderkey") % 100).alias("lease_expires"),
        F.lit("c").alias("claim_token"), F.col("o_orderpriority").alias("kind"), (F.col("o_orderkey") % 1000).alias("created_at"),
    )


@query(sql(""" SELECT count(*) FILTER (state = 'waiting') AS waiting, count(*) FILTER (state = 'running') AS running, (SELECT count(*) FROM customer WHERE 1000 - c_custkey % 1000 <= 90) AS workers,
  (SELECT count(*) FROM customer WHERE 1000 - c_custkey % 1000 <= 90 AND c_custkey NOT IN (SELECT worker_id FROM tasks WHERE state = 'running')) AS idle FROM tasks""", TASKS))
def queue_status(spark, sf):
    workers = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("worker_id"), (F.col("c_custkey") % 1000).alias("seen_at"))
    return rooms.queue_status(_tasks(spark, sf), workers, 1000)


@query(sql(""" SELECT c_custkey AS worker_id, 1000 - c_custkey % 1000 AS ago, c_custkey NOT IN (SELECT worker_id FROM tasks WHERE state = 'running') AS idle FROM customer WHERE 1000 - c_custkey % 1000 <= 90""", TASKS))
def idle_workers(spark, sf):
    workers = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("worker_id"), (F.col("c_custkey") % 1000).alias("seen_at"))
    return rooms.idle_workers(_tasks(spark, sf), workers, 1000)


@query(sql(" SELECT c_custkey AS worker_id, arg_min(task_id, (created_at, task_id)) AS task_id FROM customer JOIN tasks ON kind IN ('1-URGENT', CASE WHEN c_custkey % 2 = 0 THEN '5-LOW' END) WHERE state = 'waiting' GROUP BY 1", TASKS))
def next_task(spark, sf):
    kinds = F.array_compact(F.array(F.lit("1-URGENT"), F.when(F.col("c_custkey") % 2 == 0, "5-LOW")))
    return rooms.next_task(_tasks(spark, sf), A.table(spark, sf, "customer").select(F.col("c_custkey").alias("worker_id"), kinds.alias("kinds")))


LATE = ", late AS (SELECT *, state = 'running' AND lease_expires <= 50 AS late FROM tasks), queue AS (SELECT task_id, CASE WHEN late THEN 'waiting' ELSE state END AS state, attempts, CASE WHEN NOT late THEN worker_id END AS worker_id, CASE WHEN late THEN 0 ELSE lease_expires END AS lease_expires, kind, created_at FROM late)"


@query(sql(LATE + " SELECT task_id, state, attempts, worker_id, lease_expires FROM queue", TASKS))
def task_requeue(spark, sf):
    return rooms.requeued(_tasks(spark, sf), 50).select("task_id", "state", "attempts", "worker_id", "lease_expires")


@query(sql(LATE + """, own AS (SELECT arg_min(task_id, (created_at, task_id)) AS own FROM queue WHERE state = 'waiting' AND kind IN ('1-URGENT', '5-LOW'))
SELECT task_id, CASE WHEN task_id = own THEN 'running' ELSE state END AS state, CASE WHEN task_id = own THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN task_id = own THEN 77 ELSE worker_id END AS worker_id,
  CASE WHEN task_id = own THEN 110 ELSE lease_expires END AS lease_expires, task_id = own AS claimed FROM queue, own""", TASKS))
def task_claim(spark, sf):
    tasks = rooms.claimed(_tasks(spark, sf), 77, ["1-URGENT", "5-LOW"], 50, "token", 60)
    return tasks.select("task_id", "state", "attempts", "worker_id", "lease_expires", F.coalesce(F.col("claim_token") == "token", F.lit(False)).alias("claimed"))


ASKED = """, kinds AS (SELECT task_id, created_at, CASE kind WHEN '1-URGENT' THEN 'a' WHEN '2-HIGH' THEN 'b' ELSE 'c' END AS kind FROM tasks WHERE state = 'waiting'),
q AS (SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY created_at, task_id) - 1 AS place, (created_at, task_id) AS o, task_id FROM kinds),
w AS (SELECT row_number() OVER (ORDER BY c_custkey) AS n, c_custkey AS turn, ['a', 'b', 'ab', 'bc', 'abc', 'c', ''][c_custkey % 7 + 1] AS can FROM customer),
f AS (
  SELECT 0::BIGINT AS n, 0::BIGINT AS turn, NULL::BIGINT AS task_id, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c
  UNION ALL
  SELECT n, turn, CASE k WHEN 'a' THEN ta WHEN 'b' THEN tb WHEN 'c' THEN tc END, a + (k = 'a')::INTEGER, b + (k = 'b')::INTEGER, c + (k = 'c')::INTEGER
  FROM (SELECT w.n, w.turn, f.a, f.b, f.c, qa.task_id AS ta, qb.task_id AS tb, qc.task_id AS tc,
          CASE least(qa.o, qb.o, qc.o) WHEN qa.o THEN 'a' WHEN qb.o THEN 'b' WHEN qc.o THEN 'c' ELSE '' END AS k
        FROM f JOIN w ON w.n = f.n + 1
        LEFT JOIN q qa ON qa.kind = 'a' AND qa.place = f.a AND contains(w.can, 'a')
        LEFT JOIN q qb ON qb.kind = 'b' AND qb.place = f.b AND contains(w.can, 'b')
        LEFT JOIN q qc ON qc.kind = 'c' AND qc.place = f.c AND contains(w.can, 'c')))
SELECT turn, turn AS worker_id, task_id FROM f WHERE task_id IS NOT NULL"""


@query("WITH RECURSIVE " + TASKS + ASKED)
def task_assignment(spark, sf):
    kind = F.when(F.col("kind") == "1-URGENT", "a").when(F.col("kind") == "2-HIGH", "b").otherwise("c")
    k = F.col("c_custkey")
    can = F.array_remove(F.split(F.element_at(F.array(*map(F.lit, ["a", "b", "ab", "bc", "abc", "c", ""])), (k % 7 + 1).cast("int")), ""), "")
    return claims.assigned(_tasks(spark, sf).withColumn("kind", kind), A.table(spark, sf, "customer").select(k.alias("turn"), k.alias("worker_id"), can.alias("kinds")))


@query(sql(" SELECT task_id FROM tasks WHERE state = 'running' AND lease_expires > 50 AND worker_id % 2 = 0", TASKS))
def fenced_reports(spark, sf):
    tasks = _tasks(spark, sf)
    reports = tasks.select("task_id", F.when(F.col("worker_id") % 2 == 0, F.col("worker_id")).otherwise(-1).alias("worker_id"), "claim_token")
    return rooms.fenced(reports, tasks, 50).select("task_id")


@query("""WITH l AS (SELECT user_id, event_type, max(event_id) AS used FROM events GROUP BY 1, 2) SELECT user_id, event_type, used, row_number() OVER (PARTITION BY user_id ORDER BY used DESC, event_type) AS place FROM l QUALIFY place <= 3""")
def recent_values(spark, sf):
    rows = _events(spark, sf).select("user_id", "event_type", F.col("event_id").alias("used"))
    return rooms.recent_values(rows, ["user_id"], "event_type", "used", 3)


@query(sql(" SELECT task_id AS id, (SELECT count(*) FROM tasks WHERE state <> 'done') AS running FROM tasks WHERE state <> 'done' ORDER BY created_at DESC, task_id LIMIT 50", TASKS))
def work_list(spark, sf):
    return rooms.work_list(_tasks(spark, sf).withColumnRenamed("task_id", "id")).select("id", "running")


@query("""SELECT o_orderkey AS room_id, CASE WHEN o_custkey % 3 = o_orderkey % 3 AND o_custkey % 2 = o_orderkey % 2 THEN o_totalprice ELSE 1.5 END AS effective_position FROM orders""")
def effective_position(spark, sf):
    rows = A.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("room_id"), (F.col("o_custkey") % 3).alias("lease_item"), (F.col("o_orderkey") % 3).alias("current_id"), (F.col("o_custkey") % 2).alias("lease_generation"),
        (F.col("o_orderkey") % 2).alias("generation"), F.col("o_totalprice").alias("lease_position"), F.lit(1.5).alias("stored_position"),
    )
    return rooms.position(rows).select("room_id", "effective_position")


@query("SELECT c_custkey AS room_id, CASE WHEN c_custkey % 5 <> 2 THEN c_name END AS queue, c_custkey % 5 AS revision FROM customer")
def delta_view(spark, sf):
    rows = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("room_id"), F.col("c_name").alias("queue"), (F.col("c_custkey") % 5).alias("revision"))
    return rooms.public_view(rows, 2)


SETTINGS = """SELECT c_custkey, {0} FROM customer"""


@query("""SELECT c_custkey AS device_id, CASE WHEN c_custkey % 3 = 0 THEN 'hall' WHEN c_custkey % 5 = 0 THEN 'room' ELSE 'ktv' END AS reverb,
  CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 100)::VARCHAR ELSE '110' END AS mic_volume, CASE WHEN c_custkey % 7 = 0 THEN '55' ELSE '100' END AS output_volume, 'list' AS view FROM customer""")
def effective_settings(spark, sf):
    own = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("device_id"), F.col("c_custkey").alias("account_id"))
    k = F.col("device_id")
    first = F.format_string('"reverb":"hall","mic_volume":%s', (k % 100).cast("string"))
    parts = F.array_compact(F.array(F.when(k % 3 == 0, first), F.when(k % 7 == 0, F.lit('"output_volume":55,"bogus":1'))))
    devices = own.withColumn("overrides", F.when(k % 11 == 1, F.lit("not json")).otherwise(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))))
    devices = devices.withColumn("overrides", F.when((k % 3 == 0) | (k % 7 == 0), F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))).otherwise(F.col("overrides")))
    accounts = own.select("account_id", F.when(F.col("account_id") % 5 == 0, '{"reverb":"room","output_volume":1}').otherwise("{}").alias("defaults"))
    out = settings.effective(devices, accounts)
    return out.select("device_id", *(F.col("effective")[c].alias(c) for c in ("reverb", "mic_volume", "output_volume", "view")))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size <= 100 AND p_size >= 0 WHEN 1 THEN p_partkey % 8 = 1 WHEN 2 THEN p_partkey % 3 = 0 ELSE false END AS valid FROM part""")
def valid_settings(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_size")
    key = F.when(k % 4 == 0, "guide_volume").when(k % 4 == 1, "view").when(k % 4 == 2, "mic_monitor").otherwise("unknown")
    value = F.when(k % 4 == 0, n.cast("string")).when(k % 4 == 1, F.when(k % 8 == 1, F.lit('"grid"')).otherwise(F.lit('"map"'))).when(k % 4 == 2, F.when(k % 3 == 0, "true").otherwise("1")).otherwise("1")
    return A.table(spark, sf, "part").select("p_partkey", settings.valid_setting(key, value).alias("valid"))


@query(sql(""", v AS (SELECT user_id AS account_id, event_type AS device_id, min(event_id) AS f, max(event_id) AS l FROM events GROUP BY 1, 2)
SELECT account_id, device_id, f AS created_at, l AS last_seen_at FROM v""", "x AS (SELECT 1)"))
def register_devices(spark, sf):
    visits = _events(spark, sf).select(F.col("user_id").alias("account_id"), F.col("event_type").alias("device_id"), F.col("event_id").alias("at"))
    empty = spark.createDataFrame([], "account_id long, device_id string, label string, created_at long, last_seen_at long")
    return settings.register(empty, visits).select("account_id", "device_id", "created_at", "last_seen_at")


@query()
def account_commands(spark, sf):
    e = _events(spark, sf)
    action = F.when(F.col("event_id") % 3 == 0, "defaults").when(F.col("event_id") % 3 == 1, "prefer").otherwise("remove_device")
    rows = e.select(F.col("user_id").cast("string").alias("account_id"), F.col("event_id").alias("seq"), action.alias("action"), F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 40).alias("expected"),
                    F.concat(F.lit('{"mic_volume":'), (F.col("event_id") % 200).cast("string"), F.lit("}")).alias("payload"), F.col("event_type").alias("device_id"))
    return settings.accounts_after(rows)


@query()
def room_commands(spark, sf):
    e = _events(spark, sf)
    action = F.element_at(F.array(*map(F.lit, ["add", "add", "next", "pause", "play", "clear", "guide", "top"])), (F.col("event_id") % 8 + 1).cast("int"))
    rows = e.select((F.col("user_id") % 20).cast("string").alias("room_id"), F.col("event_id").alias("seq"), F.concat(F.lit("c"), (F.col("event_id") - F.col("event_id") % 2).cast("string"), action).alias("command_id"), action.alias("action"),
                    F.col("user_id").cast("string").alias("member_id"), F.concat(F.lit("song"), (F.col("event_id") % 50).cast("string")).alias("job_id"), F.concat(F.lit("i"), (F.col("event_id") % 9).cast("string")).alias("item_id"),
                    F.lit(None).cast("int").alias("expected_revision"), F.lit(None).cast("double").alias("position"), (F.col("event_id") % 2 == 0).alias("enabled"))
    return rooms.rooms_after(rows)


@query()
def room_log(spark, sf):
    """Outcomes of commands and players that fell silent; tests compare with a plain loop."""
    e = _events(spark, sf)
    k = F.col("event_id")
    action = F.element_at(F.array(*map(F.lit, ["add", "report", "report", "next", "pause", "play", "seek", "report"])), (k % 8 + 1).cast("int"))
    none = lambda kind: F.lit(None).cast(kind)
    rows = e.select((F.col("user_id") % 20).cast("string").alias("room_id"), k.alias("seq"), F.col("ts").alias("at"), F.concat(F.lit("c"), k.cast("string")).alias("command_id"), action.alias("action"), F.col("user_id").cast("string").alias("member_id"), none("string").alias("role"),
                    F.concat(F.lit("song"), (k % 50).cast("string")).alias("job_id"), F.concat(F.lit("i"), (k % 9).cast("string")).alias("item_id"), none("int").alias("expected_revision"), (k % 5).cast("int").alias("generation"), (k % 100).cast("double").alias("position"), none("double").alias("duration"), none("boolean").alias("enabled"))
    return room_stream.room_events(rows, 4_000_000_000_000).drop("state")


@query("""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, ['create', 'update', 'update', 'cancel', 'retry', 'update'][event_id % 6 + 1] AS action,
  event_id % 5 + 1 AS g, CASE event_id % 6 WHEN 5 THEN 'done' WHEN 2 THEN 'running' END AS to_state, event_id % 100 AS p FROM events),
f AS (
  SELECT DISTINCT job_id, 0::BIGINT AS n, NULL::VARCHAR AS state, 0::BIGINT AS generation, 0::BIGINT AS progress, 0::BIGINT AS accepted, 0::BIGINT AS refused FROM e
  UNION ALL
  SELECT job_id, n, CASE WHEN NOT ok THEN state WHEN action IN ('create', 'retry') THEN 'queued' WHEN action = 'cancel' THEN 'cancelled' ELSE coalesce(to_state, state) END,
    CASE WHEN ok AND action IN ('create', 'retry') THEN generation + 1 ELSE generation END, CASE WHEN NOT ok OR action = 'cancel' THEN progress WHEN action = 'update' THEN p ELSE 0 END,
    accepted + ok::INTEGER, refused + (NOT ok)::INTEGER
  FROM (SELECT f.job_id, e.n, e.action, e.to_state, e.p, f.state, f.generation, f.progress, f.accepted, f.refused,
          CASE e.action WHEN 'create' THEN f.state IS NULL WHEN 'retry' THEN coalesce(f.state IN ('error', 'cancelled'), false)
            WHEN 'cancel' THEN coalesce(f.state NOT IN ('done', 'error', 'cancelled'), false) ELSE coalesce(f.state NOT IN ('done', 'error', 'cancelled'), false) AND e.g = f.generation END AS ok
        FROM f JOIN e ON e.job_id = f.job_id AND e.n = f.n + 1))
SELECT job_id, state, generation::INTEGER AS generation, progress::INTEGER AS progress, accepted::INTEGER AS accepted, refused::INTEGER AS refused FROM f QUALIFY n = max(n) OVER (PARTITION BY job_id)""")
def job_lifecycle(spark, sf):
    e = _events(spark, sf)
    action = F.element_at(F.array(*map(F.lit, ["create", "update", "update", "cancel", "retry", "update"])), (F.col("event_id") % 6 + 1).cast("int"))
    state = F.when(F.col("event_id") % 6 == 5, "done").when(F.col("event_id") % 6 == 2, "running")
    rows = e.select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), action.alias("action"), (F.col("event_id") % 5 + 1).cast("int").alias("generation"), state.alias("state"), (F.col("event_id") % 100).cast("int").alias("progress"))
    return jobs.jobs_after(rows)


@query("""WITH s AS (SELECT user_id AS guest, event_id AS t, props AS job_id, value AS d, event_id + 2000.0::DOUBLE AS e FROM events),
o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY guest ORDER BY t) = 1)
SELECT guest, job_id, least(e, t + least(d + 300, 1200))::DOUBLE AS expires_at FROM o""")
def guest_trials(spark, sf):
    rows = _events(spark, sf).select(F.col("user_id").alias("guest"), F.col("event_id").alias("at"), F.col("props").alias("job_id"), F.col("value").alias("duration"), (F.col("event_id") + 2000.0).alias("session_end"))
    return jobs.trials(rows).select("guest", "job_id", F.col("expires_at").cast("double").alias("expires_at"))


@query("""WITH t AS (SELECT c_custkey AS guest, CASE WHEN c_custkey % 2 = 0 THEN 'j' END AS job_id, (c_custkey % 100)::DOUBLE AS expires_at, CASE WHEN c_custkey % 9 = 0 THEN 1.0 END AS done FROM customer)
SELECT guest, CASE WHEN done IS NOT NULL THEN 'complete' WHEN expires_at <= 40 THEN 'expired' WHEN job_id IS NOT NULL THEN 'active' ELSE 'available' END AS trial, greatest(0.0, expires_at - 40)::DOUBLE AS remaining FROM t""")
def trial_states(spark, sf):
    k = F.col("c_custkey")
    rows = A.table(spark, sf, "customer").select(k.alias("guest"), F.when(k % 2 == 0, "j").alias("job_id"), (k % 100).cast("double").alias("expires_at"), F.when(k % 9 == 0, 1.0).alias("completed_at"))
    return jobs.trial_state(rows, 40.0).select("guest", "trial", "remaining")


@query(sql(" SELECT worker_id AS job_id, kind, arg_min(task_id, (created_at, task_id)) AS id, count(*) AS asked FROM tasks WHERE state IN ('waiting', 'running') GROUP BY 1, 2", TASKS))
def active_operations(spark, sf):
    rows = _tasks(spark, sf).select(F.col("worker_id").alias("job_id"), "kind", F.col("task_id").alias("id"), "created_at", F.when(F.col("state") == "waiting", "queued").otherwise(F.col("state")).alias("state"))
    return jobs.active_operations(rows).select("job_id", "kind", "id", "asked")


@query("SELECT p_partkey, p_size >= 5 AND p_size > p_partkey % 30 AS replace FROM part")
def lyric_replacement(spark, sf):
    return jobs.worth_replacing(A.table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("new_lines"), (F.col("p_partkey") % 30).alias("line_count"))).select("p_partkey", "replace")


def _reports(spark, sf):
    return A.heartbeats(spark, sf).withColumn("generation", F.lit(1)).withColumn("position_ms", F.col("at_ms") % 3_600_000)


REPORTS = BEATS + """, r AS (SELECT row_number() OVER (PARTITION BY key ORDER BY at_ms, id) AS n, key, at_ms, at_ms % 3600000 AS pos, status FROM beats)"""
EVIDENCE = "WITH RECURSIVE " + REPORTS + """, f AS (
  SELECT key, n, at_ms, pos, CASE WHEN status = 'playing' THEN pos END AS opened, at_ms AS since, NULL::BIGINT AS told, false AS yes, status = 'playing' AS known FROM r WHERE n = 1
  UNION ALL
  SELECT key, n, at_ms, pos, CASE WHEN x = 'shut' THEN NULL WHEN x = 'open' THEN pos ELSE opened END, CASE WHEN x = 'open' THEN at_ms ELSE since END, CASE WHEN x = 'tell' THEN at_ms ELSE told END, x = 'tell', known OR x = 'open'
  FROM (SELECT f.key, r.n, r.at_ms, r.pos, f.opened, f.since, f.told, f.known,
          CASE WHEN r.status <> 'playing' THEN 'shut' WHEN NOT f.known OR f.opened IS NULL OR r.pos < f.opened OR r.pos - f.opened > r.at_ms - f.since + 3000 THEN 'open'
               WHEN least(r.pos - f.opened, r.at_ms - f.since) >= 3000 AND (f.told IS NULL OR r.at_ms - f.told >= 10000) THEN 'tell' ELSE 'keep' END AS x
        FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1))
SELECT key, 1 AS generation, at_ms, pos AS position_ms FROM f WHERE yes"""


@query(EVIDENCE)
def playback_evidence(spark, sf):
    return evidence.confirmed(_reports(spark, sf))


@query(sql(""", l AS (SELECT key, arg_max(at_ms, (at_ms, id)) AS at_ms, arg_max(status, (at_ms, id)) AS status FROM beats GROUP BY 1)
SELECT key, at_ms, 1706635660000 - at_ms < 12000 AS held, 1706635660000 - at_ms < 12000 AND status = 'playing' AS playing FROM l""", BEATS))
def lease_states(spark, sf):
    return evidence.leases(A.heartbeats(spark, sf), 1706635660000).select("key", "at_ms", "held", "playing")


@query(sql(" SELECT key, max(at_ms) AS seen_ms FROM beats GROUP BY 1 HAVING 1706635660000 - max(at_ms) < 30000", BEATS))
def live_presence(spark, sf):
    return evidence.live_devices(A.heartbeats(spark, sf), 1706635660000)


@query(sql(""", c AS (SELECT user_id % 40 AS room_id, user_id % 3 AS item, user_id % 2 AS g FROM events GROUP BY ALL)
SELECT event_id FROM events WHERE event_id % 3 = (user_id % 40) % 3 AND event_id % 2 = 1 AND value IS NOT NULL""", "x AS (SELECT 1)"))
def accepted_reports(spark, sf):
    e = _events(spark, sf)
    reports = e.select("event_id", (F.col("user_id") % 40).alias("room_id"), (F.col("event_id") % 3).alias("current_id"), (F.col("event_id") % 2).alias("generation"), F.col("value").alias("position"))
    current = spark.range(40).select(F.col("id").alias("room_id"), (F.col("id") % 3).alias("item_id"), F.lit(1).alias("generation"))
    return evidence.accepted(reports, current)[0].select("event_id")


@query("""WITH d AS (SELECT c_custkey AS id, c_nationkey::VARCHAR AS account_id, c_custkey::VARCHAR AS device_id, c_name AS label, c_custkey % 4 AS revision FROM customer)
SELECT account_id, device_id, CASE WHEN id % 3 = 0 AND revision = 2 THEN 'new ' || device_id ELSE label END AS label, revision + CASE WHEN id % 3 = 0 AND revision = 2 THEN 1 ELSE 0 END AS revision,
  CASE WHEN id % 3 = 0 AND revision = 2 THEN CASE WHEN id % 2 = 0 THEN NULL ELSE 'hall' END ELSE 'hall' END AS reverb, CASE WHEN id % 3 = 0 AND revision = 2 THEN '7' END AS volume,
  CASE WHEN id % 3 <> 0 THEN 'same' WHEN revision = 2 THEN 'changed' ELSE 'conflict' END AS said FROM d""")
def device_updates(spark, sf):
    k = F.col("c_custkey")
    rows = A.table(spark, sf, "customer").select(k, F.col("c_nationkey").cast("string").alias("account_id"), k.cast("string").alias("device_id"), F.col("c_name").alias("label"), F.lit('["player"]').alias("roles"), F.lit('{"reverb":"hall"}').alias("overrides"), (k % 4).alias("revision"))
    ask = rows.where("c_custkey % 3 = 0").select("account_id", "device_id", F.lit(2).alias("expected"), F.concat(F.lit("new "), "device_id").alias("label"), F.lit(None).cast("string").alias("roles"), F.lit('{"mic_volume":7,"nope":1}').alias("overrides"), (k % 2 == 0).alias("clear"))
    out = settings.updated_devices(rows.drop("c_custkey"), ask).withColumn("own", settings.parsed(F.col("overrides")))
    return out.select("account_id", "device_id", "label", "revision", F.col("own")["reverb"].alias("reverb"), F.col("own")["mic_volume"].alias("volume"), "said")


@query("""WITH d AS (SELECT c_nationkey::VARCHAR AS account_id, c_custkey::VARCHAR AS device_id, c_custkey % 3 <> 0 AS player FROM customer),
a AS (SELECT n_nationkey::VARCHAR AS account_id, (SELECT min(c_custkey) FROM customer WHERE c_nationkey = n_nationkey)::VARCHAR AS preferred FROM nation)
SELECT a.account_id, CASE WHEN player THEN preferred END AS preferred_player, CASE WHEN preferred IS NOT NULL AND NOT coalesce(player, false) THEN 6 ELSE 5 END AS revision FROM a LEFT JOIN d ON d.account_id = a.account_id AND d.device_id = a.preferred""")
def lost_players(spark, sf):
    c = A.table(spark, sf, "customer")
    devices = c.select(F.col("c_nationkey").cast("string").alias("account_id"), F.col("c_custkey").cast("string").alias("device_id"), F.when(F.col("c_custkey") % 3 != 0, '["player"]').otherwise('["screen"]').alias("roles"))
    first = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_custkey").cast("string").alias("preferred_player"))
    accounts = A.table(spark, sf, "nation").join(first, "n_nationkey", "left").select(F.col("n_nationkey").cast("string").alias("account_id"), "preferred_player", F.lit(5).alias("revision"))
    return settings.without_lost_players(accounts, devices)
