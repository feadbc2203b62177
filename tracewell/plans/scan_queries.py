"""Queries over what was said, tool calls, timings and receipts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions.text import ANNOUNCE, CLAIM, CODE_HEREDOC, DANGER, EDITS, FORCE, GOODBYE, HEREDOC, LOOKING, NEGATIVE, POSITIVE, REDIRECT, SHELLS, TOOL_ALIASES, VERIFY_TOOLS
from tracewell.operators import receipts, scans, timings, toolstream
from tracewell.plans.event_queries import _TASKS
from tracewell.plans.registry import query
from tracewell.sources.adapters import EPOCH_MS


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _any(markers: tuple[str, ...]) -> str:
    return _text("(?i)" + "|".join(markers))


def _list(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


#: The events' and conversations' weeks lie in winter, when the zone is five hours behind UTC.
_LOCAL = "make_timestamp((first_ms - 18000000) * 1000)"
_DOW = f"isodow({_LOCAL})"
_NAME = "lower(strftime({}, '%b%d'))"
_WINDOW = f"""CASE WHEN ({_DOW} = 5 AND hour({_LOCAL}) >= 18) THEN 'W-' || {_NAME.format(_LOCAL + " + INTERVAL 1 DAY")} WHEN {_DOW} = 6 THEN 'W-' || {_NAME.format(_LOCAL)}
  WHEN {_DOW} = 7 THEN 'W-' || {_NAME.format(_LOCAL + " - INTERVAL 1 DAY")} WHEN {_DOW} = 1 AND hour({_LOCAL}) < 6 THEN 'W-' || {_NAME.format(_LOCAL + " - INTERVAL 2 DAY")}
  ELSE 'wd-' || {_NAME.format(f"{_LOCAL} - to_days(CAST({_DOW} - 1 AS INTEGER))")} END"""
_ENDING = f"CASE WHEN coalesce(last, '') = '' THEN '?' WHEN regexp_matches(right(last, 400), {_text('(?i)' + GOODBYE)}) THEN 'signoff' WHEN regexp_matches(right(last, 400), {_any(NEGATIVE)}) THEN 'ABRUPT+frustrated' ELSE 'abrupt' END"
_TALK = f"said AS (SELECT fleet, session, id, ts, coalesce(content, '') AS content, len(regexp_extract_all(coalesce(content, ''), {_any(NEGATIVE)})) AS neg, len(regexp_extract_all(coalesce(content, ''), {_any(POSITIVE)})) AS pos FROM talk WHERE kind = 'user_message' AND meta IS NULL)"
_FRUSTRATION = f"""{_TALK}, fr0 AS (SELECT fleet, session, count(*) AS n_user, CAST(sum(neg) AS BIGINT) AS hits, list_sort(list_distinct(flatten(list(list_transform(regexp_extract_all(content, {_any(NEGATIVE)}), lambda m: left(m, 24))))))[1:4] AS m,
  arg_min(ts, id) AS first_ms, arg_max(content, id) AS last FROM said GROUP BY fleet, session HAVING count(*) >= 2),
fr AS (SELECT fleet || ':' || session AS session_ref, n_user, hits, array_to_string(m, '|') AS markers, first_ms, {_WINDOW} AS "window", {_ENDING} AS ending FROM fr0)"""
_SENTIMENT = f"""{_TALK}, se0 AS (SELECT fleet, session, count(*) AS n_user, CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(neg) AS BIGINT) AS neg, min(ts) AS first_ms, arg_max(content, id) AS last FROM said GROUP BY fleet, session HAVING count(*) >= 2),
se AS (SELECT fleet || ':' || session AS session_ref, n_user, pos, neg, pos - neg AS net, 100 * (pos - neg) / n_user AS rate, first_ms, {_WINDOW} AS "window", {_ENDING} AS ending FROM se0)"""


@query("A18_frustration", f"WITH {_FRUSTRATION} SELECT * FROM fr")
def _(t):
    return scans.frustration(t.talk)


@query("A19_frustration_windows", f'WITH {_FRUSTRATION} SELECT "window", count(*) AS sessions, count(*) FILTER (hits > 0) AS with_hits, CAST(sum(n_user) AS BIGINT) AS n_user, CAST(sum(hits) AS BIGINT) AS hits, min(first_ms) AS first_ms, 100 * sum(hits) / sum(n_user) AS per_100 FROM fr GROUP BY "window"')
def _(t):
    return scans.frustration_windows(scans.frustration(t.talk))


@query("A24_frustration_signals", f"WITH {_FRUSTRATION} SELECT session_ref, CASE WHEN hits >= 4 OR ending = 'ABRUPT+frustrated' THEN 'high' WHEN hits >= 2 THEN 'med' ELSE 'low' END AS severity, hits || ' markers in ' || n_user || ' messages' AS why FROM fr WHERE hits > 0")
def _(t):
    return scans.frustration_signals(scans.frustration(t.talk))


@query("A20_sentiment", f"WITH {_SENTIMENT} SELECT * FROM se")
def _(t):
    return scans.sentiment(t.talk)


@query("A21_sentiment_windows", f'WITH {_SENTIMENT} SELECT "window", count(*) AS sessions, CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(neg) AS BIGINT) AS neg, CAST(sum(net) AS BIGINT) AS net FROM se GROUP BY "window"')
def _(t):
    return scans.sentiment_windows(scans.sentiment(t.talk))


_TOOL = "lower(regexp_replace(coalesce(tool_name, ''), '^mcp__.*__', ''))"
_BEHAVIOR = f"""r AS (SELECT fleet, session, count(*) FILTER (kind = 'user_message') OVER (PARTITION BY fleet, session ORDER BY id ROWS UNBOUNDED PRECEDING) AS segment, kind = 'user_message' AS u, coalesce(content, '') AS c, tool_name, command, {_TOOL} AS tool
  FROM talk WHERE kind = 'assistant_message_event' OR (kind = 'user_message' AND meta IS NULL)),
g AS (SELECT fleet, session, segment, count(*) FILTER (u) AS n_user, count(*) FILTER (NOT u) AS n_asst, count(*) FILTER (NOT u AND regexp_matches(c, {_text('(?i)' + CLAIM)})) AS claims, count(*) FILTER (NOT u AND regexp_matches(c, {_text('(?i)' + ANNOUNCE)})) AS announces,
  coalesce(bool_or(NOT u AND tool_name IS NOT NULL AND (tool IN {_list(VERIFY_TOOLS)} OR (tool IN {_list(SHELLS)} AND regexp_matches(coalesce(command, ''), {_text('(?i)' + LOOKING)})))), false) AS verify,
  bool_or(u AND regexp_matches(left(c, 200), {_text('(?i)' + REDIRECT)})) AS redirect, list_sort(coalesce(list(DISTINCT tool) FILTER (NOT u AND tool_name IS NOT NULL), [])) AS tools FROM r GROUP BY ALL),
h AS (SELECT *, lag(tools) OVER (PARTITION BY fleet, session ORDER BY segment) AS before FROM g),
be AS (SELECT fleet, session, CAST(sum(n_user) AS BIGINT) AS n_user, CAST(sum(n_asst) AS BIGINT) AS n_asst, CAST(sum(CASE WHEN verify THEN claims ELSE 0 END) AS BIGINT) AS claim_then_verify, CAST(sum(CASE WHEN len(tools) = 0 THEN claims ELSE 0 END) AS BIGINT) AS claim_no_tool,
  CAST(sum(CASE WHEN len(tools) > 0 THEN announces ELSE 0 END) AS BIGINT) AS announce_then_act, count(*) FILTER (redirect AND n_asst > 0 AND (before IS NULL OR before <> tools)) AS correction_change, count(*) FILTER (redirect AND n_asst > 0 AND before IS NOT NULL AND before = tools) AS correction_same
  FROM h GROUP BY ALL HAVING sum(n_user) >= 2),
bh AS (SELECT *, CASE WHEN correction_change + correction_same > 0 THEN correction_change / (correction_change + correction_same) END AS release_rate FROM be)"""


@query("A22_behavior", f"WITH {_BEHAVIOR} SELECT * FROM bh")
def _(t):
    return scans.behavior(t.talk)


@query("A23_behavior_totals", f"WITH {_BEHAVIOR} SELECT fleet, count(*) AS sessions, avg(release_rate) AS mean_release, 100 * sum(claim_no_tool) / sum(n_user) AS claims_per_100 FROM bh GROUP BY fleet")
def _(t):
    return scans.behavior_totals(scans.behavior(t.talk))


@query("A53_halves", f"""
WITH {_TALK}, x AS (SELECT *, row_number() OVER (PARTITION BY fleet, session ORDER BY id) AS i, count(*) OVER (PARTITION BY fleet, session) AS n FROM said),
p AS (SELECT fleet, session, avg(neg) FILTER (i <= n // 2) AS a, avg(neg) FILTER (i > n // 2) AS b FROM x WHERE n >= 2 GROUP BY ALL)
SELECT count(*) AS sessions, quantile_cont(a, 0.5) AS first_median, quantile_cont(b, 0.5) AS second_median, count(*) FILTER (b > a) AS rising FROM p
""")
def _(t):
    return scans.halves(t.talk, 2)


_BANDS = "CASE WHEN n < 3 THEN 'S' WHEN n < 6 THEN 'M' ELSE 'L' END"


@query("A48_marker_rates", f"WITH {_TALK}, p AS (SELECT fleet, session, count(*) AS n, sum(neg) AS hits FROM said GROUP BY ALL) SELECT fleet, {_BANDS} AS band, count(*) AS sessions, count(*) FILTER (hits > 0) AS present, 1000 * sum(hits) / sum(n) AS per_1000 FROM p GROUP BY ALL")
def _(t):
    return scans.marker_rates(t.talk)


@query("W05_stratified_sample", f"WITH {_TALK}, p AS (SELECT fleet, session, count(*) AS n FROM said GROUP BY ALL), q AS (SELECT *, {_BANDS} AS band FROM p), z AS (SELECT *, row_number() OVER (PARTITION BY fleet, band ORDER BY md5(session), session) AS rank FROM q) SELECT * FROM z WHERE rank <= 20")
def _(t):
    return scans.stratified_sample(t.talk)


_FLAGS = f"""c AS (SELECT fleet, session, id, {_TOOL} AS tool, command, file_path FROM ev WHERE kind = 'tool_call'),
d AS (SELECT *, tool IN {_list(EDITS)} AND file_path IS NOT NULL AS edit, CASE WHEN tool IN {_list(SHELLS)} THEN coalesce(command, '') END AS cmd,
  coalesce(bool_or(tool = 'read') OVER (PARTITION BY fleet, session, file_path ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS read_before FROM c),
e AS (SELECT *, count(*) FILTER (edit) OVER (PARTITION BY fleet, session, file_path ORDER BY id ROWS UNBOUNDED PRECEDING) AS edits FROM d),
fl AS (SELECT fleet, session, count(*) AS calls, bool_or(tool IN {_list(SHELLS)}) AS has_shell, bool_or(tool IN {_list(EDITS)}) AS has_edit, bool_or(coalesce(regexp_matches(cmd, {_text(HEREDOC)}), false)) AS heredoc,
  bool_or(coalesce(regexp_matches(cmd, {_text(CODE_HEREDOC)}), false)) AS code_in_heredoc, bool_or(coalesce(cmd LIKE '%> notes.txt%', false)) AS shell_file_write, bool_or(coalesce(length(cmd) > 800, false)) AS large_bash, bool_or(coalesce(regexp_matches(cmd, {_text('(?i)' + DANGER)}), false)) AS dangerous_bash,
  bool_or(coalesce(regexp_matches(cmd, {_text('(?i)' + FORCE)}), false)) AS force_push, bool_or(edit AND edits >= 5) AS edit_loop, bool_or(edit AND NOT read_before) AS edit_before_read FROM e GROUP BY ALL)"""
_UNPIVOT = "un AS (SELECT fleet, session, calls, predicate, fired, CASE WHEN predicate LIKE 'edit%' THEN has_edit ELSE has_shell END AS exposed FROM (UNPIVOT fl ON heredoc, code_in_heredoc, shell_file_write, large_bash, dangerous_bash, force_push, edit_loop, edit_before_read INTO NAME predicate VALUE fired))"


# The pattern for writes by the shell looks around, which DuckDB's can't: in the adapters' commands it is the one that redirects to notes.txt.
@query("A42_violations", f"WITH {_FLAGS} SELECT * FROM fl")
def _(t):
    return toolstream.violations(t.ev)


@query("A43_prevalence", f"WITH {_FLAGS}, {_UNPIVOT} SELECT fleet, predicate, count(*) AS sessions, count(*) FILTER (fired) AS fired, 100 * avg(CAST(fired AS DOUBLE)) AS percent FROM un GROUP BY ALL")
def _(t):
    return toolstream.prevalence(toolstream.violations(t.ev))


@query("A44_at_risk_rates", f"WITH {_FLAGS}, {_UNPIVOT} SELECT predicate, fleet, count(*) AS sessions, count(*) FILTER (fired) AS fired, avg(CAST(fired AS DOUBLE)) AS rate FROM un WHERE exposed GROUP BY GROUPING SETS ((predicate), (predicate, fleet))")
def _(t):
    return toolstream.at_risk_rates(toolstream.violations(t.ev))


@query("A49_rate_lift", f"""
WITH {_FLAGS}, {_UNPIVOT}, la AS (SELECT fleet, session, count(*) AS messages, sum(len(regexp_extract_all(coalesce(content, ''), {_any(NEGATIVE)}))) AS hits FROM ev WHERE kind = 'user_message' AND meta IS NULL GROUP BY ALL),
ra AS (SELECT predicate, count(*) FILTER (fired) AS n_with, count(*) FILTER (NOT fired) AS n_without, CAST(sum(hits) FILTER (fired) AS DOUBLE) / nullif(sum(messages) FILTER (fired), 0) AS rate_with, CAST(sum(hits) FILTER (NOT fired) AS DOUBLE) / nullif(sum(messages) FILTER (NOT fired), 0) AS rate_without FROM un JOIN la USING (fleet, session) GROUP BY predicate)
SELECT *, rate_with / nullif(rate_without, 0) AS lift FROM ra
""")
def _(t):
    return toolstream.rate_lift(toolstream.violations(t.ev), _language(t))


@query("A50_banded_lift", f"""
WITH {_FLAGS}, {_UNPIVOT}, la AS (SELECT fleet, session, count(*) AS messages, sum(len(regexp_extract_all(coalesce(content, ''), {_any(NEGATIVE)}))) AS hits FROM ev WHERE kind = 'user_message' AND meta IS NULL GROUP BY ALL)
SELECT CASE WHEN calls < 2 THEN 'S' WHEN calls < 5 THEN 'M' ELSE 'L' END AS band, predicate, count(*) FILTER (fired) AS n_with, count(*) FILTER (NOT fired) AS n_without,
  (CAST(sum(hits) FILTER (fired) AS DOUBLE) / nullif(sum(messages) FILTER (fired), 0)) / nullif(CAST(sum(hits) FILTER (NOT fired) AS DOUBLE) / nullif(sum(messages) FILTER (NOT fired), 0), 0) AS lift FROM un JOIN la USING (fleet, session) GROUP BY ALL
""")
def _(t):
    return toolstream.banded_lift(toolstream.violations(t.ev), _language(t))


def _language(t):
    from pyspark.sql import functions as F

    from tracewell.functions.text import marks

    return scans.operator_messages(t.ev).groupBy("fleet", "session").agg(F.count("*").alias("messages"), F.sum(marks(F.coalesce("content", F.lit("")), NEGATIVE)).alias("hits"))


def _invocations(fleet: str) -> str:
    start = "kind = 'provider_status_update' AND state = 'awaiting_first_token'" if fleet == "mu" else "kind IN ('user_message', 'tool_result')"
    ttft = "stream_ms - start_ms" if fleet == "mu" else "CAST(NULL AS BIGINT)"
    return f"""i0 AS (SELECT *, {start} AS st, kind = 'assistant_message_event' AS sa FROM ev WHERE fleet = '{fleet}' AND (({start}) OR kind = 'assistant_message_event' OR state = 'streaming')),
i1 AS (SELECT *, count(*) FILTER (st) OVER (PARTITION BY fleet, session ORDER BY id ROWS UNBOUNDED PRECEDING) AS call FROM i0),
i2 AS (SELECT *, count(*) FILTER (sa) OVER (PARTITION BY fleet, session, call ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS answers FROM i1 WHERE call > 0),
i3 AS (SELECT fleet, session, call, min(ts) FILTER (st) AS start_ms, max(ts) FILTER (sa) AS end_ms, max(output_tokens) FILTER (sa) AS tokens, max(ts) FILTER (state = 'streaming') AS stream_ms FROM i2 WHERE answers = 0 GROUP BY ALL),
iv AS (SELECT fleet, session, call, start_ms, end_ms, end_ms - start_ms AS duration_ms, {ttft} AS ttft_ms, tokens, CAST(1 AS BIGINT) AS invocations FROM i3 WHERE end_ms IS NOT NULL)"""


@query("A37_invocations_mu", f"WITH {_invocations('mu')} SELECT * FROM iv")
def _(t):
    return timings.invocations(t.ev, "mu")


@query("A37_invocations_cc", f"WITH {_invocations('cc')} SELECT * FROM iv")
def _(t):
    return timings.invocations(t.ev, "cc")


@query("A38_turns", """
WITH a AS (SELECT *, count(*) FILTER (kind = 'user_message') OVER (PARTITION BY fleet, session ORDER BY id ROWS UNBOUNDED PRECEDING) AS turn FROM ev WHERE kind IN ('user_message', 'done', 'assistant_message_event')),
b AS (SELECT *, count(*) FILTER (kind = 'done') OVER (PARTITION BY fleet, session, turn ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM a WHERE turn > 0),
c AS (SELECT fleet, session, turn, min(ts) FILTER (kind = 'user_message') AS start_ms, max(ts) FILTER (kind <> 'user_message') AS end_ms, count(*) FILTER (kind = 'assistant_message_event') AS invocations, CAST(sum(output_tokens) AS BIGINT) AS tokens FROM b WHERE ended = 0 GROUP BY ALL)
SELECT *, end_ms - start_ms AS duration_ms FROM c WHERE invocations > 0
""")
def _(t):
    return timings.turns(t.ev)


def _stats(calls: str, ttft: bool = True) -> str:
    """The statistics of calls(fleet, model, day, ...) by the four grains."""
    cols = {"duration": "duration_ms", "ttft": "ttft_ms" if ttft else None, "speed": "speed"}
    qs = ", ".join(f"round(quantile_cont({c}, {p / 100}), 6) AS {m}_p{p}" if c else f"CAST(NULL AS DOUBLE) AS {m}_p{p}" for m, c in cols.items() for p in (50, 75, 90, 99))
    return f"""SELECT CASE WHEN grouping(fleet) = 1 THEN 'day' WHEN grouping(model) = 0 THEN 'fleet_model' WHEN grouping(day) = 0 THEN 'fleet_day' ELSE 'fleet' END AS grain, fleet, model, day, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens,
  sum(invocations) / count(*) AS invocations_mean, max(invocations) AS invocations_max, min(start_ms) AS first_ms, max(end_ms) AS last_ms, {qs} FROM {calls} GROUP BY GROUPING SETS ((fleet), (fleet, model), (day), (fleet, day))"""


#: The family of a model, in SQL.
_FAMILY = "CASE WHEN contains(lower(model), 'fable') THEN 'fable' WHEN contains(lower(model), 'opus') THEN 'opus' WHEN contains(lower(model), 'sonnet') THEN 'sonnet' WHEN contains(lower(model), 'haiku') THEN 'haiku' WHEN contains(lower(model), 'gpt') THEN 'gpt' WHEN contains(lower(model), 'gemini') THEN 'gemini' WHEN contains(lower(model), 'qwen') THEN 'qwen' ELSE 'other' END"


@query("A36_timing_stats", f"""
WITH {_invocations("mu").replace("FROM ev", "FROM ev2")}, sm AS (SELECT fleet, session, arg_min(model, (-n, model)) AS model FROM (SELECT fleet, session, model, count(*) AS n FROM ev WHERE kind = 'task_telemetry' GROUP BY ALL) AS c GROUP BY fleet, session),
ok AS (SELECT fleet, {_FAMILY} AS model, CAST(make_timestamp(start_ms * 1000) AS DATE) AS day, start_ms, end_ms, duration_ms, ttft_ms, tokens, invocations, CASE WHEN duration_ms - coalesce(ttft_ms, 0) > 1 AND tokens > 0 THEN tokens * 1000.0 / (duration_ms - coalesce(ttft_ms, 0)) END AS speed FROM iv LEFT JOIN sm USING (fleet, session) WHERE duration_ms BETWEEN 0 AND 1800000)
{_stats("ok")}
""".replace("WITH ", f"WITH ev2 AS (SELECT * REPLACE ({EPOCH_MS} + (ts - {EPOCH_MS}) // 1000 AS ts) FROM ev), ", 1), dates=("day",))
def _(t):
    """The events' clock is slowed down a thousandfold, as a model call is no matter of days."""
    ev = t.ev.withColumn("ts", F.lit(EPOCH_MS) + F.expr(f"(ts - {EPOCH_MS}) div 1000"))
    return timings.timing_stats(timings.within(timings.with_models(timings.invocations(ev, "mu"), ev)))


@query("F23_model_families", f"WITH {_TASKS} SELECT CASE WHEN contains(lower(model), 'fable') THEN 'fable' WHEN contains(lower(model), 'opus') THEN 'opus' WHEN contains(lower(model), 'sonnet') THEN 'sonnet' WHEN contains(lower(model), 'haiku') THEN 'haiku' WHEN contains(lower(model), 'gpt') THEN 'gpt' WHEN contains(lower(model), 'gemini') THEN 'gemini' WHEN contains(lower(model), 'qwen') THEN 'qwen' ELSE 'other' END AS family, count(*) AS tasks, CAST(sum(completion_tokens) AS BIGINT) AS tokens FROM tasks GROUP BY 1")
def _(t):
    from tracewell.operators.sessions import tasks

    return timings.by_family(tasks(t.ev))


_SINCE, _UNTIL = 1_705_276_800_000, 1_705_881_600_000  # a week in the middle of the events' month
_RECEIPTS = f"""ac AS (SELECT DISTINCT fleet, session FROM ev WHERE ts >= {_SINCE} AND ts < {_UNTIL}),
re AS (SELECT fleet, session, min(ts) FILTER (ts >= {_SINCE} AND ts < {_UNTIL}) AS first_ms, max(ts) FILTER (ts >= {_SINCE} AND ts < {_UNTIL}) AS last_ms, count(*) FILTER (ts >= {_SINCE} AND ts < {_UNTIL} AND kind = 'user_message') AS turns,
  count(*) FILTER (ts >= {_SINCE} AND ts < {_UNTIL} AND kind = 'tool_call') AS tool_calls, max(model) FILTER (kind = 'task_telemetry') AS model, max(completion_tokens) AS max_tokens FROM ev SEMI JOIN ac USING (fleet, session) GROUP BY ALL)"""


@query("A39_receipts", f"WITH {_RECEIPTS} SELECT * FROM re")
def _(t):
    return receipts.receipts(t.ev, _SINCE, _UNTIL)


@query("A41_receipt_totals", f"WITH {_RECEIPTS} SELECT fleet, count(*) AS sessions, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(tool_calls) AS BIGINT) AS tool_calls FROM re GROUP BY ROLLUP (fleet)")
def _(t):
    return receipts.totals(receipts.receipts(t.ev, _SINCE, _UNTIL))


@query("A40_tool_breakdown", f"""
WITH c AS (SELECT fleet, session, replace(replace(lower(trim(tool_name)), ' ', '_'), '-', '_') AS low FROM ev WHERE kind = 'tool_call'),
n AS (SELECT fleet, session, CASE low {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TOOL_ALIASES.items())} ELSE low END AS tool, count(*) AS n FROM c GROUP BY ALL)
SELECT fleet, session, string_agg(tool || '=' || n, ',' ORDER BY n DESC, tool) AS tools FROM n GROUP BY ALL
""")
def _(t):
    return receipts.tool_breakdown(t.ev)
