"""Queries that join several operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions.text import NEGATIVE
from tracewell.operators import panels, reports, scans, sessions
from tracewell.plans.registry import query
from tracewell.plans.scan_queries import _FRUSTRATION, _WINDOW, _any

_REF = "fleet || ':' || session"


@query("A65_transcript_lines", r"""
WITH x AS (SELECT fleet, session, row_number() OVER (PARTITION BY fleet, session ORDER BY id) AS n, CASE WHEN kind = 'user_message' THEN CASE WHEN meta IS NOT NULL THEN 'SYSTEM' ELSE 'USER' END ELSE 'ASSISTANT' END AS role, content,
  trim(regexp_replace(regexp_extract(content, '(?m)^\s*(\S.*)$', 1), '\s+', ' ', 'g')) AS short FROM talk WHERE trim(content) <> '')
SELECT fleet, session, n, '[' || lpad(CAST(n AS VARCHAR), 3, '0') || '] ' || role || ': ' || left(content, 1200) AS line, CASE WHEN length(short) > 96 THEN rtrim(left(short, 95)) || '…' ELSE short END AS preview FROM x
""")
def _(t):
    return reports.transcript_lines(t.talk)


@query("S13_changed_transcripts", f"WITH n AS (SELECT {_REF} AS session_ref, max(id) AS last_id FROM ev GROUP BY 1), m AS (SELECT {_REF} AS session_ref, max(id) AS had FROM ev WHERE id % 3 <> 0 GROUP BY 1) SELECT session_ref, last_id FROM n LEFT JOIN m USING (session_ref) WHERE had IS NULL OR last_id > had")
def _(t):
    had = t.ev.where("id % 3 <> 0").groupBy(sessions.session_ref(F.col("fleet"), F.col("session")).alias("session_ref")).agg(F.max("id").alias("last_id"))
    return reports.changed_transcripts(t.ev, had)


@query("U07_attention", f"""
WITH {_FRUSTRATION}, a AS (SELECT session_ref, 'language' AS source FROM fr WHERE hits > 0
  UNION ALL SELECT DISTINCT 'mu:' || daemon || ':' || session_id, 'done' FROM ev WHERE fleet = 'mu' AND kind = 'done' AND stop_reason IN ('degraded_eof', 'max_tokens', 'iteration_cap', 'aborted')
  UNION ALL SELECT {_REF}, 'mark' FROM ev WHERE kind = 'operator_mark')
SELECT session_ref, count(DISTINCT source) AS sources, count(*) AS signals FROM a GROUP BY session_ref
""")
def _(t):
    ref = sessions.session_ref(F.col("fleet"), F.col("session")).alias("session_ref")
    language = scans.frustration(t.talk).where("hits > 0").withColumn("source", F.lit("language"))
    bad = t.ev.where("fleet = 'mu' and kind = 'done'").where(F.col("stop_reason").isin("degraded_eof", "max_tokens", "iteration_cap", "aborted")).select(ref).distinct().withColumn("source", F.lit("done"))
    marked = t.ev.where("kind = 'operator_mark'").select(ref, F.lit("mark").alias("source"))
    return reports.attention(language, bad, marked)


@query("J24_identities", """
WITH s AS (SELECT fleet, daemon, session_id, session, min(ts) AS started_ms, fleet || ':' || session AS session_ref, fleet || '·' || left(sha256(session), 8) AS display_id FROM ev GROUP BY ALL),
a AS (SELECT DISTINCT unnest([display_id, session_ref, session, session_id, daemon]) AS alias, display_id, session_ref, started_ms FROM s)
SELECT alias, display_id, session_ref FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY started_ms DESC, session_ref DESC) AS r FROM a) AS x WHERE r = 1
""")
def _(t):
    return reports.identities(t.ev.groupBy("fleet", "daemon", "session_id", "session").agg(F.min("ts").alias("started_ms")))


_LINES = "'[' || (CASE k % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END) || '] ' || stop_reason || ' @event ' || CAST(id AS STRING) || ': after ' || CAST(elapsed_ms AS STRING) || ' ms'"


@query("F27_findings", f"SELECT {_REF} AS session_ref, CASE k % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, stop_reason AS invariant, id AS event_id, 'after ' || elapsed_ms || ' ms' AS detail FROM ev WHERE kind = 'done'")
def _(t):
    """Lines as an auditor writes them, made from endings, and parsed again."""
    return reports.parsed_findings(t.ev.where("kind = 'done'").select(sessions.session_ref(F.col("fleet"), F.col("session")).alias("session_ref"), F.expr(_LINES).alias("line")))


@query("A31_findings_by_day", "SELECT CAST(make_timestamp(ts * 1000) AS DATE) AS day, count(*) FILTER (k % 3 = 0) AS high, count(*) FILTER (k % 3 = 1) AS med, count(*) FILTER (k % 3 = 2) AS low, CAST(0 AS BIGINT) AS other FROM ev WHERE kind = 'done' GROUP BY 1", dates=("day",))
def _(t):
    lines = t.ev.where("kind = 'done'").select(F.col("id").cast("string").alias("session_ref"), F.expr(_LINES).alias("line"), panels.day().alias("day"))
    found = reports.parsed_findings(lines)
    return reports.findings_by_day(found.join(lines.select("session_ref", "day"), "session_ref"))


_GAPS = f"""o AS (SELECT fleet, session, id, ts, len(regexp_extract_all(coalesce(content, ''), {_any(NEGATIVE)})) AS hits FROM ev WHERE kind = 'user_message' AND meta IS NULL),
w AS (SELECT *, lag(ts) OVER (PARTITION BY fleet, session ORDER BY id) AS b, sum(hits) OVER (PARTITION BY fleet, session ORDER BY id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS hb FROM o),
gp AS (SELECT fleet, session, id, (ts - b) / 3600000.0 AS hours, CAST(hour(make_timestamp(b * 1000)) AS BIGINT) AS left_hour, CAST(coalesce(hb, 0) AS BIGINT) AS hits_before, hits AS hits_after FROM w WHERE (ts - b) / 3600000.0 >= 3)"""


@query("W12_long_gaps", f"WITH {_GAPS} SELECT * FROM gp")
def _(t):
    return reports.long_gaps(t.ev)


@query("A54_leaving_hours", f"WITH {_GAPS}, n AS (SELECT left_hour, count(*) AS n FROM gp GROUP BY 1) SELECT left_hour, n FROM n WHERE n = (SELECT max(n) FROM n)")
def _(t):
    return reports.leaving_hours(reports.long_gaps(t.ev))


@query("A59_band_density", f"""
WITH p AS (SELECT fleet, session, count(*) FILTER (kind = 'user_message' AND meta IS NULL) AS m, count(*) FILTER (kind = 'tool_call') AS c, coalesce(sum(len(regexp_extract_all(coalesce(content, ''), {_any(NEGATIVE)}))) FILTER (kind = 'user_message' AND meta IS NULL), 0) AS h FROM ev GROUP BY ALL)
SELECT CASE WHEN c < 2 THEN 'S' WHEN c < 5 THEN 'M' ELSE 'L' END AS band, count(*) AS sessions, avg(m) AS messages, avg(c) AS tools, CAST(sum(m) AS DOUBLE) / nullif(sum(c), 0) AS messages_per_tool, CAST(sum(h) AS BIGINT) AS hits FROM p GROUP BY 1
""")
def _(t):
    return reports.band_density(t.ev)


@query("A58_maturity", """
WITH p AS (SELECT fleet, session, min(ts) AS f, bool_or(kind = 'compaction_assembly') AS c, bool_or(kind = 'worker_spawned') AS w, bool_or(kind = 'recall_provenance') AS r, bool_or(kind = 'operator_mark') AS m FROM ev GROUP BY ALL)
SELECT CAST(date_trunc('week', make_timestamp(f * 1000)) AS DATE) AS week, count(*) AS sessions, count(*) FILTER (c) AS compaction, count(*) FILTER (w) AS workers, count(*) FILTER (r) AS recall, count(*) FILTER (m) AS marks FROM p GROUP BY 1
""", dates=("week",))
def _(t):
    return reports.maturity(t.ev)


_INCIDENT = ("incident", 1_704_600_000_000, 1_704_900_000_000)


@query("J19_explicit_windows", f"""
WITH p AS (SELECT fleet, session, min(ts) AS first_ms FROM ev GROUP BY ALL)
SELECT CASE WHEN first_ms BETWEEN {_INCIDENT[1]} AND {_INCIDENT[2]} THEN 'incident' ELSE {_WINDOW} END AS "window", count(*) AS sessions, min(first_ms) AS first_ms FROM p GROUP BY 1
""")
def _(t):
    return reports.explicit_windows(t.ev, [_INCIDENT])


@query("S09_normalised", """
WITH e AS (SELECT conv_id, turn AS pos, 0 AS rank, 'user_message' AS kind FROM conversations WHERE role = 'user'
  UNION ALL SELECT conv_id, turn, 2, 'assistant_message_event' FROM conversations WHERE role = 'assistant'
  UNION ALL SELECT conv_id, turn, 4, 'done' FROM conversations WHERE role = 'assistant' AND turn % 3 <> 0
  UNION ALL SELECT conv_id, -1, 5, 'session_created' FROM conversations WHERE role = 'assistant' GROUP BY conv_id
  UNION ALL SELECT conv_id, 1000000000, 5, 'task_telemetry' FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT 'c' || conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos, rank) AS id, kind FROM e WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'assistant')
""")
def _(t):
    """Conversations as raw transcript records, each assistant message streamed in two records."""
    from tracewell.sources import transcripts

    c = t.table("conversations")
    part = F.explode(F.when(F.col("role") == "assistant", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    message = F.to_json(F.struct(F.format_string("m%d-%d", "conv_id", "turn").alias("id"), "role", F.lit("claude-opus-4-8").alias("model"), F.when((F.col("turn") % 3 == 0), "tool_use").otherwise("end_turn").alias("stop_reason"), F.concat(F.lit("t "), F.coalesce("text", F.lit(""))).alias("content")))
    rows = c.withColumn("part", part).select(F.format_string("c%d", "conv_id").alias("session_id"), (F.col("turn") * 2 + F.col("part")).alias("pos"), F.col("role").alias("type"), F.lit("2026-01-01T00:00:00Z").alias("timestamp"), F.lit(False).alias("isMeta"), message.alias("message"))
    return transcripts.normalised(rows).select("session_id", "id", "kind")


@query("S08_skipped_records", "SELECT role AS type, count(*) AS n FROM conversations WHERE role NOT IN ('user', 'assistant') GROUP BY role")
def _(t):
    from tracewell.sources import transcripts

    return transcripts.skipped(t.table("conversations").withColumnRenamed("role", "type"))
