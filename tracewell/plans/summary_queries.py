"""Queries that choose and sum up: default sessions, totals, whole lists by session, sorted queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import panels, scans, sessions, stores, summaries, timings
from tracewell.plans.event_queries import _KEYED, NOW_MS
from tracewell.plans.registry import ORACLES, query
from tracewell.plans.scan_queries import _FRUSTRATION, _TALK, _invocations, _stats
from tracewell.sources.adapters import EPOCH_MS
from tracewell.plans.store_queries import _MARKS, _VERDICT_SQL, _current, _ledger, _marks, _verdicts

_MODEL_OF = "max_by(model, ts * 1000000 + id) AS {} FROM ev WHERE kind = 'task_telemetry' AND model IS NOT NULL"


def _duck(name: str) -> str:
    """Another query's SQL, as a table."""
    return f"({ORACLES[name]})"


@query("T02_best_trajectory", """
WITH p AS (SELECT daemon, count(*) FILTER (kind = 'context_assembly' AND token_count IS NOT NULL) AS points, count(*) FILTER (kind = 'context_assembly') AS assemblies,
  max(token_count) FILTER (kind = 'context_assembly') - min(token_count) FILTER (kind = 'context_assembly') AS range, count(*) FILTER (kind = 'compaction_assembly') AS compactions
  FROM ev WHERE kind IN ('context_assembly', 'compaction_assembly') GROUP BY daemon)
SELECT *, points >= 15 AND compactions >= 1 AS fits FROM p ORDER BY fits DESC, CASE WHEN points >= 15 AND compactions >= 1 THEN range END DESC NULLS LAST, assemblies DESC, daemon LIMIT 1
""")
def _(t):
    return summaries.best_trajectory(t.ev)


@query("T03_default_session", """
SELECT daemon, session_id, count(*) AS turns, count(*) BETWEEN 12 AND 60 AS fits FROM ev WHERE kind = 'assistant_message_event' GROUP BY daemon, session_id ORDER BY fits DESC, turns DESC, daemon, session_id LIMIT 1
""")
def _(t):
    return summaries.default_session(t.ev)


@query("T04_ask_candidates", f"""
WITH p AS (SELECT daemon, session_id, count(*) FILTER (kind = 'assistant_message_event') AS turns, CAST(sum(coalesce(cache_write_tokens, 0)) AS BIGINT) AS cache_writes, max(ts) FILTER (kind = 'assistant_message_event') AS last_ts
  FROM ev WHERE kind IN ('assistant_message_event', 'task_telemetry') GROUP BY daemon, session_id),
own AS (SELECT daemon, session_id, {_MODEL_OF.format("own")} GROUP BY daemon, session_id), dm AS (SELECT daemon, {_MODEL_OF.format("of_daemon")} GROUP BY daemon)
SELECT daemon, session_id, coalesce(own, of_daemon) AS model, turns, cache_writes, last_ts FROM p LEFT JOIN own USING (daemon, session_id) LEFT JOIN dm USING (daemon) WHERE turns BETWEEN 4 AND 60
ORDER BY coalesce(starts_with(coalesce(own, of_daemon), 'claude-'), false) DESC, cache_writes DESC, turns DESC, daemon, session_id LIMIT 40
""")
def _(t):
    return summaries.ask_candidates(t.ev)


@query("A66_daemon_models", f"SELECT daemon, {_MODEL_OF.format('model')} GROUP BY daemon")
def _(t):
    return summaries.latest_models(t.ev, "daemon")


def _units(tokens: str, rate: str, times: str) -> str:
    return f"CAST(sum(CAST(round(coalesce({tokens} * {rate} * {times} / 1e6, 0.0) * 1e10) AS BIGINT)) AS BIGINT)"


_PARTS = {"input": ("prompt_tokens", "i", "1.0::DOUBLE"), "output": ("completion_tokens", "o", "1.0::DOUBLE"), "cache_read": ("cache_read_tokens", "i", "0.1::DOUBLE"), "cache_write": ("cache_write_tokens", "i", "1.25::DOUBLE")}


@query("A30_cost_composition", f"""
WITH {_KEYED} SELECT fleet, session, {", ".join(f'{_units(*p)} / 1e10 AS "{n}"' for n, p in _PARTS.items())}, ({" + ".join(_units(*p) for p in _PARTS.values())}) / 1e10 AS cost
FROM ev LEFT JOIN keyed USING (model) LEFT JOIN rates USING (rate_key) WHERE kind = 'task_telemetry' GROUP BY fleet, session ORDER BY cost DESC, fleet, session LIMIT 1
""")
def _(t):
    return summaries.cost_composition(t.ev)


@query("A32_mark_summary", f"WITH {_MARKS} SELECT count(*) AS marks, count(DISTINCT session_ref) AS sessions, count(DISTINCT CAST(make_timestamp(created_ms * 1000) AS DATE)) AS days FROM mk")
def _(t):
    return summaries.mark_summary(_marks(t, "true"))


@query("A35_verdict_lists", f"""
WITH {_VERDICT_SQL} SELECT session_ref, string_agg(concat_ws(' ', CASE WHEN occurred = 1 THEN '+' ELSE '-' END, behavior, severity), ';' ORDER BY CASE WHEN occurred = 1 THEN 0 ELSE 1 END, behavior) AS verdicts FROM vl GROUP BY session_ref
""")
def _(t):
    return summaries.verdict_lists(_verdicts(t))


@query("A52_context_summary", """
WITH r AS (SELECT fleet, session, id, token_count AS c, lag(token_count) OVER (PARTITION BY fleet, session ORDER BY id) AS b FROM ev WHERE token_count > 0),
p AS (SELECT fleet, session, CAST(floor(arg_min(c, id) / 1000) AS BIGINT) AS k, count(*) FILTER (b - c >= greatest(20000.0, 0.3 * b)) AS spots FROM r GROUP BY ALL HAVING count(*) >= 2),
s AS (SELECT *, row_number() OVER (PARTITION BY fleet ORDER BY k, session) - 1 AS i, count(*) OVER (PARTITION BY fleet) AS n FROM p)
SELECT fleet, count(*) AS sessions, max(k) FILTER (i = least(n - 1, floor(0.1 * n))) AS p10_k, max(k) FILTER (i = least(n - 1, floor(0.5 * n))) AS median_k, max(k) FILTER (i = least(n - 1, floor(0.9 * n))) AS p90_k,
  count(*) FILTER (spots > 0) AS compacted, CAST(sum(spots) AS BIGINT) AS spots FROM s GROUP BY fleet
""")
def _(t):
    return summaries.context_summary(t.ev)


@query("A55_strata", f"SELECT fleet, band, count(*) AS n FROM {_duck('W05_stratified_sample')} AS s GROUP BY fleet, band")
def _(t):
    return summaries.strata(scans.stratified_sample(t.talk))


@query("F30_topics", "SELECT fleet, session, arg_min(left(replace(content, chr(10), ' '), 200), id) AS topic FROM talk WHERE kind = 'user_message' AND meta IS NULL AND content IS NOT NULL GROUP BY fleet, session")
def _(t):
    return summaries.topics(t.talk)


@query("T09_flagged_total", """
WITH m AS (SELECT * FROM ev WHERE fleet = 'mu'),
f AS (SELECT daemon, session_id, 'deg' AS reason FROM m WHERE kind = 'done' AND stop_reason IN ('degraded_eof', 'max_tokens', 'iteration_cap', 'aborted')
  UNION ALL SELECT daemon, session_id, 'err' FROM m WHERE kind = 'task_telemetry' AND exit_reason IN ('error', 'cancelled')
  UNION ALL SELECT daemon, session_id, 'err' FROM m WHERE kind = 'tool_result' AND is_error GROUP BY ALL HAVING count(*) >= 5
  UNION ALL SELECT daemon, session_id, 'callout' FROM m WHERE kind = 'callout' UNION ALL SELECT daemon, session_id, 'deg' FROM m WHERE kind = 'autonomous_terminated')
SELECT reason, count(*) AS n FROM (SELECT DISTINCT * FROM f) AS g GROUP BY reason
""")
def _(t):
    return summaries.flagged_total(t.ev)


@query("T10_ranked_signals", f"""
WITH {_FRUSTRATION}, s AS (SELECT session_ref, CASE WHEN hits >= 4 OR ending = 'ABRUPT+frustrated' THEN 'high' WHEN hits >= 2 THEN 'med' ELSE 'low' END AS severity, hits FROM fr WHERE hits > 0)
SELECT *, CAST(CASE severity WHEN 'high' THEN 0 WHEN 'med' THEN 1 ELSE 2 END AS BIGINT) AS rank FROM s ORDER BY rank, hits DESC, session_ref LIMIT 400
""")
def _(t):
    scan = scans.frustration(t.talk)
    return summaries.ranked_signals(scans.frustration_signals(scan).select("session_ref", "severity").join(scan.select("session_ref", "hits"), "session_ref"))


_SHOWN = ("wd-jan01", "W-jan06")


@query("T07_shown_sessions", f"""
WITH {_FRUSTRATION}, h AS (SELECT session_ref, hits, n_user, "window", row_number() OVER (ORDER BY hits / greatest(n_user, 1) DESC, hits DESC, session_ref) <= 20 AS listed FROM fr WHERE hits > 0)
SELECT * FROM h WHERE listed OR "window" IN {_SHOWN}
""")
def _(t):
    return summaries.shown_sessions(scans.frustration(t.talk), _SHOWN)


@query("P04_real_sessions", """
SELECT fleet, session, count(*) AS events FROM ev WHERE fleet = 'mu' GROUP BY fleet, session HAVING NOT coalesce(bool_or(lower(model) = 'faux' OR coalesce(lower(provider) IN ('faux', 'mock'), false)), false)
""")
def _(t):
    return summaries.real_sessions(t.ev)


@query("J02_sessionized", f"""
WITH k AS (SELECT task_id, max(ts) AS ts FROM ev WHERE kind = 'task_telemetry' GROUP BY task_id),
s AS (SELECT daemon, session_id, unnest(string_split(task_ids, ',')) AS task_id FROM {_duck("A07_session_map")} AS m)
SELECT k.task_id, ts, daemon, session_id, session_id IS NOT NULL AS matched FROM k LEFT JOIN s USING (task_id)
""")
def _(t):
    return summaries.sessionized(sessions.tasks(t.ev), sessions.session_map(t.ev))


@query("J13_keyed_messages", """
WITH k AS (SELECT session_id, min(task_id) AS task FROM ev WHERE kind = 'task_telemetry' AND fleet = 'cc' GROUP BY session_id),
r AS (SELECT fleet, CASE WHEN fleet = 'mu' THEN daemon || '/' || session_id ELSE task END AS key FROM ev LEFT JOIN k USING (session_id) WHERE kind IN ('user_message', 'assistant_message_event', 'tool_call', 'tool_result'))
SELECT fleet, key, count(*) AS events FROM r WHERE key IS NOT NULL GROUP BY fleet, key
""")
def _(t):
    return summaries.keyed_messages(t.ev)


@query("A33_delegation_totals", f"SELECT outcome, count(*) AS workers, count(DISTINCT fleet || ':' || session) AS orchestrators, avg(took) AS mean_ms FROM {_duck('A33_delegations')} AS d GROUP BY outcome")
def _(t):
    return summaries.delegation_totals(panels.delegations(t.ev, NOW_MS))


@query("T12_newest_delegations", f"SELECT fleet, session, n, ts, outcome FROM {_duck('A33_delegations')} AS d ORDER BY ts DESC, fleet, session, n LIMIT 50")
def _(t):
    return panels.delegations(t.ev, NOW_MS).select("fleet", "session", "n", "ts", "outcome").orderBy(F.desc("ts"), "fleet", "session", "n").limit(50)


@query("A69_marker_presence", f"""
WITH {_FRUSTRATION}, c AS (SELECT fleet || ':' || session AS session_ref, max(id) AS max_context FROM talk GROUP BY 1)
SELECT session_ref, n_user, hits, hits > 0 AS present, max_context FROM fr LEFT JOIN c USING (session_ref)
""")
def _(t):
    """The conversations carry no token counts: their number of turns stands for the context."""
    contexts = t.talk.groupBy(sessions.session_ref(F.col("fleet"), F.col("session")).alias("session_ref")).agg(F.max("id").alias("max_context"))
    return summaries.marker_presence(scans.frustration(t.talk), contexts)


@query("U08_newest_copies", "SELECT session, max_by(daemon || '/' || kind, (ts, daemon || '/' || kind)) AS path, max(ts) AS mtime FROM (SELECT session, daemon, kind, max(ts) AS ts FROM ev GROUP BY ALL) AS f GROUP BY session")
def _(t):
    """Each kind of event as a root that has a copy of the session."""
    files = t.ev.groupBy("session", F.concat_ws("/", "daemon", "kind").alias("path")).agg(F.max("ts").alias("mtime"))
    return summaries.newest_copies(files)


@query("J26_flagged_by_marks", f"""
WITH {_MARKS}, n AS (SELECT DISTINCT CASE WHEN id % 2 = 0 THEN session_ref ELSE left(session_ref, 2) || '·' || left(sha256(substr(session_ref, 4)), 8) END AS ref FROM mk), s AS (SELECT DISTINCT fleet, session FROM ev)
SELECT fleet, session, fleet || ':' || session IN (SELECT ref FROM n) OR fleet || '·' || left(sha256(session), 8) IN (SELECT ref FROM n) AS flagged FROM s
""")
def _(t):
    """Marks of even events name sessions by reference, others by display id."""
    from tracewell.operators.reports import short_id

    display = short_id(F.col("fleet"), F.col("session"))
    marks = t.ev.where("kind = 'operator_mark'").select(F.when(F.col("id") % 2 == 0, sessions.session_ref(F.col("fleet"), F.col("session"))).otherwise(display).alias("session_ref"))
    return summaries.flagged_by_marks(t.ev.select("fleet", "session").distinct().withColumn("display_id", display), marks)


@query("A68_priced_sessions", f"SELECT fleet, count(*) AS sessions, count(*) FILTER (cost > 0) AS priced, CAST(sum(CAST(round(cost * 1e4) AS BIGINT)) AS BIGINT) / 1e4 AS cost FROM {_duck('A11_session_features')} AS f GROUP BY fleet")
def _(t):
    return sessions.feature_coverage(sessions.session_features(t.ev))


_HALF = 1_705_276_800_000


@query("S20_replaced_findings", f"""
WITH f AS (SELECT daemon AS path, id, ts FROM ev WHERE kind = 'callout'), cu AS (SELECT DISTINCT daemon AS path FROM ev WHERE daemon <> 'd3'), nw AS (SELECT path, id FROM f WHERE ts >= {_HALF})
SELECT path, id FROM f WHERE ts < {_HALF} AND path IN (SELECT path FROM cu) AND path NOT IN (SELECT path FROM nw) UNION ALL SELECT path, id FROM nw
""")
def _(t):
    """The month's first half as the store, the second as what is scanned anew; one path is gone."""
    found = t.ev.where("kind = 'callout'").select(F.col("daemon").alias("path"), "id", "ts")
    return stores.replace_by_source(found.where(F.col("ts") < _HALF).select("path", "id"), found.where(F.col("ts") >= _HALF).select("path", "id"), t.ev.where("daemon <> 'd3'").select(F.col("daemon").alias("path")).distinct())


_CALLS = f"""tk AS (SELECT *, CAST(NULL AS VARCHAR) AS state, length(content) AS output_tokens FROM talk), {_invocations("cc").replace("FROM ev ", "FROM tk ")}"""
_OPEN, _SHUT, _LEAST = EPOCH_MS + 20 * 7_200_000, EPOCH_MS + 90 * 7_200_000, 60


@query("P08_talk_timing_stats", f"""
WITH {_CALLS}, ok AS (SELECT *, CAST(NULL AS VARCHAR) AS model, CAST(make_timestamp(start_ms * 1000) AS DATE) AS day, CASE WHEN duration_ms > 1 AND tokens > 0 THEN tokens * 1000.0 / duration_ms END AS speed FROM iv
  WHERE duration_ms BETWEEN 0 AND 1800000 AND end_ms >= {_OPEN} AND start_ms <= {_SHUT} AND tokens >= {_LEAST})
{_stats("ok", ttft=False)}
""", dates=("day",))
def _(t):
    """Answers in conversations that overlap a window and have a least length (characters stand for tokens)."""
    talk = t.talk.withColumns({"state": F.lit(None).cast("string"), "output_tokens": F.length("content").cast("long")})
    calls = timings.within(timings.invocations(talk, "cc"), _OPEN, _SHUT)
    return timings.timing_stats(timings.workload(calls, tokens=(_LEAST, None)))


@query("A47_overall_rates", f"""
WITH {_TALK}, p AS (SELECT fleet, session, count(*) AS n, CAST(sum(neg) AS BIGINT) AS hits FROM said GROUP BY fleet, session)
SELECT fleet, count(*) AS sessions, count(*) FILTER (hits > 0) AS present, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(n) AS BIGINT) AS messages, 1000 * sum(hits) / sum(n) AS per_1000 FROM p GROUP BY ROLLUP (fleet)
""")
def _(t):
    return scans.overall_rates(t.talk)


@query("J05_candidate_asks", f"SELECT a.* FROM {_duck('A62_per_ask')} AS a SEMI JOIN {_duck('T04_ask_candidates')} AS c USING (daemon, session_id)")
def _(t):
    return panels.per_ask(summaries.restricted(t.ev, summaries.ask_candidates(t.ev), *summaries.MU_KEY))


@query("J06_changed_events", f"SELECT fleet, session, count(*) AS n FROM ev WHERE fleet || ':' || session IN (SELECT path FROM {_duck('J18_changed_sources')} AS c) GROUP BY fleet, session")
def _(t):
    rows = t.ev.withColumn("path", sessions.session_ref(F.col("fleet"), F.col("session")))
    return panels.histogram(summaries.restricted(rows, stores.changed(_current(t), _ledger(t)), "path"), "fleet", "session")
