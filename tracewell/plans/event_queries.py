"""Queries over the event relation."""

from __future__ import annotations

from tracewell.dims import MODEL_KINDS, PROVIDER_KINDS, PROVIDER_PREFIXES
from tracewell.functions.text import TOOL_ALIASES
from tracewell.operators import costs, panels, sessions
from tracewell.plans.registry import query

NOW_MS = 1_706_659_200_000  # the end of the events' month


def _case(column: str, table: dict[str, str], otherwise: str) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {otherwise} END"


_BARE = f"regexp_replace(lower(model), '^(?:{'|'.join(PROVIDER_PREFIXES)})', '')"
_KEYED = f"keyed AS (SELECT model, max_by(rate_key, length(rate_key)) AS rate_key FROM (SELECT DISTINCT model FROM ev WHERE model IS NOT NULL) AS m JOIN rates ON starts_with({_BARE}, rate_key) GROUP BY model)"
_PRICE = "(prompt_tokens * i + cache_write_tokens * i * 1.25 + cache_read_tokens * i * 0.1 + completion_tokens * o) / 1e6"
_KIND = f"CASE WHEN coalesce(model, '') = '' THEN 'free' ELSE {_case('lower(model)', MODEL_KINDS, _case('lower(coalesce(provider, chr(32)))', PROVIDER_KINDS, chr(39) + 'unknown' + chr(39)))} END"
_TASKS = f"""{_KEYED}, last_task AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, id DESC) AS r FROM ev WHERE kind = 'task_telemetry') AS x WHERE r = 1),
tools AS (SELECT fleet, session, count(*) AS tool_calls FROM ev WHERE kind = 'tool_call' GROUP BY fleet, session),
tasks AS (SELECT task_id, fleet, session, model, provider, exit_reason, coalesce(outcome_class, 'unclassified') AS outcome_class, coalesce(tool_calls, 0) AS tool_calls,
  prompt_tokens, completion_tokens, cache_read_tokens, cache_write_tokens, ts, rate_key IS NOT NULL AS is_priced, coalesce({_PRICE}, 0.0) AS cost, {_KIND} AS cost_kind,
  CAST(make_timestamp(ts * 1000) AS DATE) AS day
  FROM last_task LEFT JOIN tools USING (fleet, session) LEFT JOIN keyed USING (model) LEFT JOIN rates USING (rate_key))"""
_SUM = "CAST(sum(CAST(round(cost * 1e10) AS BIGINT)) AS BIGINT) / 1e10"
_BAD = "('degraded_eof', 'aborted', 'error', 'max_tokens', 'iteration_cap')"


@query("A01_histogram", "SELECT kind, count(*) AS n FROM ev GROUP BY kind")
def _(t):
    return panels.histogram(t.ev, "kind")


@query("A02_fleet_histogram", "SELECT fleet, kind, count(*) AS n FROM ev GROUP BY fleet, kind")
def _(t):
    return panels.histogram(t.ev, "fleet", "kind")


@query("A03_corpus_totals", "SELECT count(*) AS events, count(DISTINCT daemon) AS daemons, count(DISTINCT fleet || ':' || session) AS sessions FROM ev")
def _(t):
    return panels.corpus_totals(t.ev)


@query("A04_tool_mix", f"""
WITH c AS (SELECT fleet, replace(replace(lower(trim(tool_name)), ' ', '_'), '-', '_') AS low FROM ev WHERE kind = 'tool_call')
SELECT {_case("low", TOOL_ALIASES, "low")} AS tool, count(*) AS n, count(*) FILTER (fleet = 'mu') AS mu, count(*) FILTER (fleet = 'cc') AS cc FROM c GROUP BY 1 ORDER BY n DESC, tool LIMIT 12
""")
def _(t):
    return panels.tool_mix(t.ev)


@query("A05_recall", "SELECT CASE recall_source WHEN 'project_file' THEN 'ProjectFile' WHEN 'filesystem' THEN 'ProjectFile' WHEN 'memory' THEN 'Memory' WHEN 'bootloader' THEN 'Bootloader' ELSE recall_source END AS source, count(*) AS items, CAST(sum(recall_tokens) AS BIGINT) AS tokens FROM ev WHERE kind = 'recall_provenance' GROUP BY 1")
def _(t):
    return panels.recall(t.ev)


@query("A06_compaction", """
SELECT fleet, count(*) FILTER (action = 'kept') AS kept, count(*) FILTER (action = 'dropped') AS dropped, count(*) FILTER (action = 'summarized') AS summarized, count(*) FILTER (action = 'failed') AS failed,
  count(*) FILTER (kind = 'compaction_assembly') AS events, CAST(coalesce(sum(tokens_before), 0) AS BIGINT) AS tokens_before, CAST(coalesce(sum(tokens_after), 0) AS BIGINT) AS tokens_after FROM ev GROUP BY fleet
""")
def _(t):
    return panels.compaction(t.ev)


@query("A07_session_map", """
SELECT daemon, session_id, min(ts) FILTER (kind = 'task_telemetry') AS started_ms, max_by(model, ts * 1000000 + id) FILTER (kind = 'task_telemetry' AND model IS NOT NULL) AS model,
  array_to_string(list_sort(list_distinct(list(task_id) FILTER (kind = 'task_telemetry'))), ',') AS task_ids, count(*) FILTER (kind = 'tool_call') AS tool_calls
FROM ev WHERE fleet = 'mu' AND kind IN ('task_telemetry', 'tool_call') GROUP BY daemon, session_id HAVING count(*) FILTER (kind = 'task_telemetry') > 0
""")
def _(t):
    return sessions.session_map(t.ev)


@query("A08_stop_reasons", "SELECT stop_reason, count(*) AS n FROM ev WHERE kind = 'done' GROUP BY stop_reason")
def _(t):
    return panels.stop_reasons(t.ev)


@query("A09_degradation_by_day", f"SELECT CAST(make_timestamp(ts * 1000) AS DATE) AS day, count(*) AS n, avg(CAST(stop_reason IN {_BAD} AS DOUBLE)) AS rate FROM ev WHERE kind = 'done' GROUP BY 1", dates=("day",))
def _(t):
    return panels.degradation_by_day(t.ev)


@query("A10_degradation_rate", f"SELECT count(*) AS n, coalesce(round(100 * avg(CAST(stop_reason IN {_BAD} AS DOUBLE)), 1), 0.0) AS percent FROM ev WHERE kind = 'done'")
def _(t):
    return panels.degradation_rate(t.ev)


@query("A11_session_features", f"""
WITH {_KEYED}, g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY fleet, session ORDER BY id) AS gap, CASE WHEN kind = CASE WHEN fleet = 'mu' THEN 'context_assembly' ELSE 'assistant_message_event' END THEN token_count END AS c FROM ev),
modal AS (SELECT fleet, session, arg_min(model, r) FILTER (what = 'm') AS model, arg_min(model, r) FILTER (what = 'p') AS provider FROM (
  SELECT *, row_number() OVER (PARTITION BY fleet, session, what ORDER BY n DESC, model) AS r FROM (
    SELECT fleet, session, 'm' AS what, model, count(*) AS n FROM ev WHERE kind = 'task_telemetry' AND model IS NOT NULL GROUP BY ALL
    UNION ALL SELECT fleet, session, 'p', provider, count(*) FROM ev WHERE kind = 'task_telemetry' AND provider IS NOT NULL GROUP BY ALL)) GROUP BY fleet, session),
s AS (SELECT fleet, session, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens,
  CAST(coalesce(sum(cache_read_tokens), 0) AS BIGINT) AS cache_read_tokens, CAST(coalesce(sum(cache_write_tokens), 0) AS BIGINT) AS cache_write_tokens, count(*) FILTER (kind = 'task_telemetry') AS n_tasks,
  min(ts) FILTER (kind = 'task_telemetry') AS started_ms, quantile_cont(elapsed_ms, 0.5) FILTER (kind = 'done') AS latency_p50, quantile_cont(elapsed_ms, 0.95) FILTER (kind = 'done') AS latency_p95,
  count(*) FILTER (kind = 'done') AS n_asks, count(*) FILTER (kind = 'tool_call') AS n_tools, count(*) FILTER (gap > 300000) AS n_gaps, max(c) AS max_context, arg_min(c, id) FILTER (c IS NOT NULL) AS first_context
  FROM g GROUP BY fleet, session)
SELECT fleet || ':' || session AS session_ref, fleet, session, n_tasks, prompt_tokens, completion_tokens, cache_read_tokens, cache_write_tokens, model, provider, started_ms, latency_p50, latency_p95, n_asks, n_tools, n_gaps, max_context, first_context,
  CAST(hour(make_timestamp(started_ms * 1000)) AS BIGINT) AS hour, CAST(isodow(make_timestamp(started_ms * 1000)) - 1 AS BIGINT) AS weekday, round(coalesce({_PRICE}, 0.0), 4) AS cost, {_KIND} AS cost_kind
FROM s JOIN modal USING (fleet, session) LEFT JOIN keyed USING (model) LEFT JOIN rates USING (rate_key) WHERE n_tasks > 0 AND lower(model) <> 'faux'
""")
def _(t):
    return sessions.session_features(t.ev)


@query("A16_cache_econ", """
WITH g AS (SELECT (ts - lag(ts) OVER (PARTITION BY fleet, daemon, session_id ORDER BY ts, id)) / 60000.0 AS gap FROM ev WHERE kind = 'assistant_message_event'),
a AS (SELECT round(coalesce(quantile_cont(gap, 0.5) FILTER (gap BETWEEN 0 AND 120), 0.0), 2) AS m, round(coalesce(quantile_cont(gap, 0.9) FILTER (gap BETWEEN 0 AND 120), 0.0), 2) AS p, count(*) FILTER (gap BETWEEN 0 AND 120) AS gap_count,
  count(*) FILTER (gap > 5 AND gap <= 60) AS expired_5m_count, count(*) FILTER (gap BETWEEN 4 AND 6) AS near_miss_4_6m_count, count(*) FILTER (gap > 60) AS over_60m_count FROM g),
v AS (SELECT CAST(coalesce(sum(cache_write_5m_tokens), 0) AS BIGINT) AS w5_tokens, CAST(coalesce(sum(cache_write_1h_tokens), 0) AS BIGINT) AS w1_tokens, CAST(coalesce(sum(cache_read_tokens), 0) AS BIGINT) AS read_tokens FROM ev WHERE kind = 'task_telemetry'),
c AS (SELECT *, 40 * ((1 - exp(-5 / m)) * 0.03 + exp(-5 / m) * 0.375) AS c5, 40 * ((1 - exp(-60 / m)) * 0.03 + exp(-60 / m) * 0.6) AS c1, 40 * ((1 - exp(-5 / p)) * 0.03 + exp(-5 / p) * 0.375) AS d5, 40 * ((1 - exp(-60 / p)) * 0.03 + exp(-60 / p) * 0.6) AS d1 FROM a)
SELECT m AS median_gap_min, p AS p90_gap_min, gap_count, expired_5m_count, near_miss_4_6m_count, over_60m_count, w5_tokens, w1_tokens, read_tokens,
  CASE WHEN m <= 0 THEN 0.0 ELSE round((c5 - c1) / c5 * 100, 1) END AS save_pct, CASE WHEN p <= 0 THEN 0.0 ELSE round((d5 - d1) / d5 * 100, 1) END AS save_pct_p90 FROM c, v
""")
def _(t):
    return panels.cache_econ(t.ev)


_ASKS = f"""{_KEYED}, q AS (SELECT *, row_number() OVER w AS n, round((ts - lag(ts) OVER w) / 60000.0, 2) AS gap_min FROM ev WHERE kind = 'task_telemetry' WINDOW w AS (PARTITION BY fleet, daemon, session_id ORDER BY ts, id)),
asks AS (SELECT fleet, daemon, session_id, n AS ask, model, gap_min, CAST(round(coalesce({_PRICE}, 0.0) * 1e10) AS BIGINT) / 1e10 AS cost, CAST(round(coalesce(cache_read_tokens * i * 1.25 / 1e6, 0.0) * 1e10) AS BIGINT) / 1e10 AS rewrite_5m, coalesce(gap_min > 5, false) AS expired_5m
  FROM q LEFT JOIN keyed USING (model) LEFT JOIN rates USING (rate_key) WHERE n <= 30)"""


@query("A62_per_ask", f"WITH {_ASKS} SELECT * FROM asks")
def _(t):
    return panels.per_ask(t.ev)


@query("A63_per_ask_sessions", f"WITH {_ASKS} SELECT fleet, daemon, session_id, count(*) AS asks, {_SUM} AS cost, count(*) FILTER (expired_5m) AS expired FROM asks GROUP BY ALL HAVING {_SUM} > 0 ORDER BY cost DESC, fleet, daemon, session_id LIMIT 12")
def _(t):
    return panels.per_ask_sessions(t.ev)


@query("A64_flagged_queue", """
WITH m AS (SELECT * FROM ev WHERE fleet = 'mu'),
f AS (SELECT daemon, session_id, 'deg' AS reason, 'stop_reason=' || stop_reason || ' mid-task' AS why FROM m WHERE kind = 'done' AND stop_reason IN ('degraded_eof', 'max_tokens', 'iteration_cap', 'aborted')
  UNION ALL SELECT daemon, session_id, 'err', 'exit_reason=' || exit_reason FROM m WHERE kind = 'task_telemetry' AND exit_reason IN ('error', 'cancelled')
  UNION ALL SELECT daemon, session_id, 'err', CAST(count(*) AS VARCHAR) || ' tool_result.is_error in session' FROM m WHERE kind = 'tool_result' AND is_error GROUP BY ALL HAVING count(*) >= 5
  UNION ALL SELECT daemon, session_id, 'callout', 'self-flag: ' || coalesce(content, '(callout)') FROM m WHERE kind = 'callout'
  UNION ALL SELECT daemon, session_id, 'deg', 'autonomous_terminated: ' || coalesce(content, '?') FROM m WHERE kind = 'autonomous_terminated'),
g AS (SELECT daemon, session_id, reason, min(why) AS why FROM f GROUP BY ALL),
l AS (SELECT daemon, session_id, max_by(model, ts * 1000000 + id) AS model FROM m WHERE kind = 'task_telemetry' AND model IS NOT NULL GROUP BY ALL)
SELECT daemon, session_id, reason, why, model, CASE reason WHEN 'deg' THEN 'Probable 0.62' WHEN 'err' THEN 'Probable 0.70' ELSE 'Definite 0.88' END AS confidence,
  CAST(CASE reason WHEN 'deg' THEN 0 WHEN 'err' THEN 1 ELSE 2 END AS BIGINT) AS severity, row_number() OVER (PARTITION BY reason ORDER BY daemon, session_id) AS turn
FROM g LEFT JOIN l USING (daemon, session_id) ORDER BY turn, severity LIMIT 12
""")
def _(t):
    return panels.flagged_queue(t.ev)


@query("W06_context_trajectory", """
WITH r AS (SELECT fleet, session, id, row_number() OVER (PARTITION BY fleet, session ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY fleet, session) AS n, round(token_count / 1000.0) AS k_tokens FROM ev WHERE token_count IS NOT NULL),
s AS (SELECT * FROM r WHERE n <= 80 OR i IN (SELECT floor(p * r.n / 80.0) FROM range(80) AS x(p)))
SELECT fleet, session, id, k_tokens, coalesce(k_tokens < lag(k_tokens) OVER (PARTITION BY fleet, session ORDER BY id), false) AS drop FROM s
""")
def _(t):
    return panels.context_trajectory(t.ev)


@query("A51_context_disparity", """
WITH p AS (SELECT fleet, session, arg_min(token_count, id) AS first, max(token_count) AS most, count(*) AS n FROM ev WHERE token_count > 0 GROUP BY ALL HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY fleet ORDER BY most, session) - 1 AS i, count(*) OVER (PARTITION BY fleet) AS c FROM p)
SELECT fleet, count(*) AS sessions, quantile_cont(first, 0.5) AS first_median, quantile_cont(most, 0.5) AS max_median, max(most) FILTER (i = least(c - 1, floor(0.9 * c))) AS max_p90, max(most) AS max_max,
  round(quantile_cont(most / first, 0.5), 6) AS growth_median FROM r GROUP BY fleet
""")
def _(t):
    return panels.context_disparity(t.ev)


@query("W07_compactions", """
WITH r AS (SELECT fleet, session, token_count AS c, lag(token_count) OVER (PARTITION BY fleet, session ORDER BY id) AS b FROM ev WHERE token_count IS NOT NULL)
SELECT fleet, session, count(*) FILTER (b - c >= greatest(20000.0, 0.3 * b)) AS spots FROM r GROUP BY ALL HAVING count(*) FILTER (b - c >= greatest(20000.0, 0.3 * b)) > 0
""")
def _(t):
    return panels.compactions(t.ev)


@query("A33_delegations", f"""
WITH s AS (SELECT fleet, session, ts, model, row_number() OVER (PARTITION BY fleet, session ORDER BY id) AS n FROM ev WHERE kind = 'worker_spawned'),
e AS (SELECT fleet, session, kind AS ended, elapsed_ms AS took, row_number() OVER (PARTITION BY fleet, session ORDER BY id) AS n FROM ev WHERE kind IN ('worker_exited', 'worker_failed', 'worker_timeout'))
SELECT fleet, session, n, ts, model, CASE WHEN ended IS NOT NULL THEN replace(ended, 'worker_', '') WHEN {NOW_MS} - ts > 21600000 THEN 'unknown-stale' ELSE 'running' END AS outcome, took FROM s LEFT JOIN e USING (fleet, session, n)
""")
def _(t):
    return panels.delegations(t.ev, NOW_MS)


@query("A33_mailbox", "SELECT message_kind, count(*) FILTER (kind = 'mailbox_message_posted') AS posted, count(*) FILTER (kind <> 'mailbox_message_posted') AS consumed FROM ev WHERE kind LIKE 'mailbox%' GROUP BY 1")
def _(t):
    return panels.mailbox(t.ev)


@query("A67_first_events", "SELECT fleet, session, arg_min(ts, ts * 1000000 + id) AS first_ms, arg_min(kind, ts * 1000000 + id) AS first_kind FROM ev GROUP BY ALL")
def _(t):
    return sessions.first_events(t.ev)


@query("S11_tasks", f"WITH {_TASKS} SELECT task_id, fleet, session, model, provider, exit_reason, outcome_class, tool_calls, prompt_tokens, completion_tokens, cache_read_tokens, cache_write_tokens, ts, is_priced, CAST(round(cost * 1e10) AS BIGINT) / 1e10 AS cost, cost_kind, day FROM tasks", dates=("day",))
def _(t):
    from pyspark.sql import functions as F

    from tracewell.dims import to_grid

    return sessions.tasks(t.ev).withColumn("cost", to_grid(F.col("cost")))


@query("A25_cost_rollups", f"WITH {_TASKS} SELECT cost_kind, fleet, model, grouping(cost_kind) * 4 + grouping(fleet) * 2 + grouping(model) AS grain, count(*) AS tasks, {_SUM} AS cost FROM tasks GROUP BY GROUPING SETS ((cost_kind), (fleet), (fleet, model))")
def _(t):
    return costs.rollups(sessions.tasks(t.ev))


@query("A26_cost_totals", f"WITH {_TASKS} SELECT count(*) AS tasks, {_SUM} AS cost, count(*) FILTER (is_priced) AS priced FROM tasks")
def _(t):
    return costs.totals(sessions.tasks(t.ev))


@query("A27_outcomes", f"WITH {_TASKS} SELECT outcome_class, count(*) AS n FROM tasks GROUP BY 1")
def _(t):
    return costs.outcomes(sessions.tasks(t.ev))


@query("A28_hallucination", f"WITH {_TASKS} SELECT fleet, model, count(*) FILTER (outcome_class IN ('narrative_no_action', 'hollow_commit', 'lying_state')) AS flagged, count(*) AS n, count(*) FILTER (outcome_class IN ('narrative_no_action', 'hollow_commit', 'lying_state')) / count(*) AS rate FROM tasks WHERE tool_calls > 0 GROUP BY ALL HAVING count(*) >= 3 ORDER BY rate DESC, n DESC, fleet, model LIMIT 10")
def _(t):
    return costs.hallucination(sessions.tasks(t.ev))


@query("A29_trend", f"WITH {_TASKS}, d AS (SELECT CAST(make_timestamp(ts * 1000) AS DATE) AS day, avg(CAST(stop_reason IN {_BAD} AS DOUBLE)) AS rate FROM ev WHERE kind = 'done' GROUP BY 1) SELECT day, count(*) AS tasks, {_SUM} AS cost, coalesce(any_value(rate), 0.0) AS rate FROM tasks LEFT JOIN d USING (day) GROUP BY day", dates=("day",))
def _(t):
    return costs.trend(sessions.tasks(t.ev), panels.degradation_by_day(t.ev))


@query("S26_unpriced", f"WITH {_TASKS} SELECT provider, model, count(*) AS tasks, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens FROM tasks WHERE NOT is_priced GROUP BY ALL")
def _(t):
    return costs.unpriced(sessions.tasks(t.ev))


@query("T05_costliest", f"WITH {_TASKS} SELECT fleet, session, count(*) AS tasks, {_SUM} AS cost FROM tasks GROUP BY ALL ORDER BY cost DESC, fleet, session LIMIT 8")
def _(t):
    return costs.costliest(sessions.tasks(t.ev))


@query("J10_rate_keys", f"WITH {_KEYED} SELECT model, rate_key, i AS input_rate, o AS output_rate FROM keyed JOIN rates USING (rate_key)")
def _(t):
    from tracewell.dims import rate_keys

    return rate_keys(t.ev, t.rates)
