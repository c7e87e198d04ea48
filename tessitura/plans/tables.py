"""The adapters of sources.adapters as SQL, to stand before a query's own."""

PLAYS = """plays AS (
  SELECT event_id AS id, user_id::VARCHAR AS account_id,
         user_id::VARCHAR || ':' || regexp_extract(props, '"k": ?(-?\\d+)', 1) || ':' || strftime(ts, '%Y-%m-%d') AS play_key,
         regexp_extract(props, '"k": ?(-?\\d+)', 1) AS job_id, epoch_us(ts)::DOUBLE / 1e6 AS started_at, value AS position,
         event_type = 'purchase' AS completed, event_type AS device_id
  FROM events)"""

CATALOG = """catalog AS (
  SELECT d.doc_id AS id, string_split(text, chr(10))[1] AS title, source AS artist, lang AS language, n_chars / 10.0::DOUBLE AS duration,
         CASE quality WHEN 1 THEN 'done' WHEN 0 THEN 'error' ELSE 'queued' END AS state, len(string_split(text, chr(10))) - 1 AS line_count
  FROM documents d LEFT JOIN labels USING (doc_id))"""

LINES = """lines AS (
  SELECT conv_id AS job_id, turn AS line_no, role AS singer, text,
         coalesce(sum(length(text) * 100) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms
  FROM conversations)"""

FILLED = LINES + """, filled AS (
  SELECT *, coalesce(lead(start_ms) OVER (PARTITION BY job_id ORDER BY line_no), start_ms + 4000) AS end_ms FROM lines)"""

BEATS = """beats AS (
  SELECT event_id AS id, user_id::VARCHAR AS key, epoch_us(ts) // 1000 AS at_ms, round(value * 1000)::BIGINT AS position_ms,
         CASE event_type WHEN 'error' THEN 'blocked' WHEN 'click' THEN 'paused' ELSE 'playing' END AS status
  FROM events)"""


#: A text's words in folded form.
WORDS = "trim(regexp_replace(strip_accents(lower(replace(replace(coalesce({0}, ''), 'ß', 'ss'), 'ς', 'σ'))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def sql(body: str, *ctes: str) -> str:
    """A query after common table expressions; its own may follow with a comma."""
    return "WITH " + ", ".join(ctes) + body
