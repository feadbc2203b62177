"""Queries over what Spark writes as files and finds again, over values of unknown shape, and over raw transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.dims import to_grid
from tracewell.operators import reports, scans, sessions, shapes, toolstream
from tracewell.functions.text import NEGATIVE
from tracewell.plans.event_queries import _TASKS
from tracewell.plans.registry import Tables, query
from tracewell.plans.scan_queries import _FLAGS, _UNPIVOT, _any
from tracewell.plans.store_queries import _MARKS, _marks
from tracewell.sources import artifacts, discovery, events, transcripts
from tracewell.sources.shared import new_folder
from tracewell.streaming import jobs


def _tree(t: Tables) -> str:
    """The events as files of lines in the layout of logs: mu sessions by machine, cc ones with benches and subagents."""
    root = new_folder(t.spark, "tree")
    mu = F.col("fleet") == "mu"
    odd = F.pmod(F.col("id"), F.lit(4))
    place = F.when(mu, F.concat(F.lit("mu/h"), F.right("daemon", F.lit(1)), F.lit("/events/"), F.col("daemon"))).otherwise(
        F.concat(F.lit("claude/h"), F.right("daemon", F.lit(1)), F.when(odd == 0, "/bench").when(odd == 1, "/subagents").otherwise("/projects"))
    )
    rows = t.ev.where("kind = 'session_created'").withColumn("place", place).select("place", F.to_json(F.struct("id", "session_id")).alias("value"))
    rows.repartition("place").write.partitionBy("place").text(root)
    return root


def _listing(t: Tables, root: str) -> DataFrame:
    """The tree's files, with the folder that the partition's name holds put back as folders."""
    files = discovery.listed(t.spark, root, names="*.txt")
    place = F.url_decode(F.regexp_extract("path", r"/place=([^/]+)/", 1))
    return files.withColumn("path", F.concat(F.lit("/root/"), place, F.lit("/"), discovery.file_name(F.col("path"))))


_PLACES = """p AS (SELECT DISTINCT CASE WHEN fleet = 'mu' THEN 'mu/h' || right(daemon, 1) || '/events/' || daemon ELSE 'claude/h' || right(daemon, 1) || CASE id % 4 WHEN 0 THEN '/bench' WHEN 1 THEN '/subagents' ELSE '/projects' END END AS place FROM ev WHERE kind = 'session_created')"""


@query("S27_listed_files", f"""
WITH {_PLACES} SELECT CASE split_part(place, '/', 1) WHEN 'claude' THEN 'cc' ELSE 'mu' END AS plane, split_part(place, '/', 2) AS host, count(*) AS files FROM p WHERE NOT contains(place, 'bench') AND NOT contains(place, '/subagents') GROUP BY ALL
""")
def _(t):
    """Sessions' files by plane and host, without benches and subagents."""
    files = discovery.standalone(_listing(t, _tree(t)))
    return discovery.with_layout(files, "/root").groupBy("plane", "host").agg(F.count("*").alias("files"))


#: How many conversations a transcript file holds at most.
BUNDLE = 256


def _raw(t: Tables) -> str:
    """Conversations as transcript files of BUNDLE each, so that there are not as many files as conversations: operator texts
    with times, answers with usage, some broken lines. Every third conversation is in a folder of the provider that bills
    tokens."""
    root = new_folder(t.spark, "raw")
    ms = 1_767_225_600_000
    at = F.when((F.col("turn") % 5 != 4) | (F.col("role") != "user"), F.date_format(F.timestamp_millis(F.lit(ms) + F.col("conv_id") * 1000 + F.col("turn") * 10_000), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    usage = F.struct((F.col("turn") + 1).alias("input_tokens"), F.lit(2).alias("output_tokens"), F.struct(F.col("turn").alias("ephemeral_5m_input_tokens"), (F.col("conv_id") % 3).alias("ephemeral_1h_input_tokens")).alias("cache_creation"))
    said = F.struct(F.format_string("m%d", "turn").alias("id"), F.lit("claude-opus-4-8").alias("model"), F.when(F.col("turn") % 3 == 0, "tool_use").otherwise("end_turn").alias("stop_reason"), F.lit("ok").alias("content"), usage.alias("usage"))
    user, session = F.struct(F.lit("user").alias("role"), F.lit("go on").alias("content")), F.format_string("c%d", "conv_id").alias("sessionId")
    line = F.when(F.col("role") == "assistant", F.to_json(F.struct(F.lit("assistant").alias("type"), session, at.alias("timestamp"), said.alias("message")))).otherwise(F.to_json(F.struct(F.col("role").alias("type"), session, at.alias("timestamp"), user.alias("message"))))
    rows = t.table("conversations").select("conv_id", F.struct("turn", F.when(F.col("turn") % 4 == 3, F.concat(line, F.lit('\n{"broken'))).otherwise(line).alias("line")).alias("x"))
    whole = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("value"))
    home = F.when(F.col("conv_id") % 3 == 0, transcripts.BILLED_PATH.strip("/")).otherwise("home")
    whole.select(home.alias("home"), "value").write.option("maxRecordsPerFile", BUNDLE).partitionBy("home").text(root)
    return root


def _normalised(t: Tables) -> DataFrame:
    records = transcripts.read_records(t.spark, _raw(t), recursiveFileLookup=True)
    provider = transcripts.provider_of(F.regexp_replace("path", "/home=", "/"))
    return transcripts.normalised(records.withColumns({"session_id": F.col("named_session"), "provider": provider}))


_TURNS = """r AS (SELECT conv_id, turn, role, CASE WHEN turn % 5 <> 4 OR role <> 'user' THEN 1767225600000 + conv_id * 1000 + turn * 10000 END AS ts FROM conversations),
a AS (SELECT *, coalesce(last_value(CASE WHEN role = 'user' THEN ts END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), min(ts) OVER (PARTITION BY conv_id)) AS ask, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS seg FROM r),
b AS (SELECT *, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id, seg ORDER BY turn ROWS UNBOUNDED PRECEDING) AS turns FROM a)"""


@query("W18_asks", f"WITH {_TURNS} SELECT 'c' || conv_id AS session_id, ts, greatest(0, ts - ask) AS elapsed_ms, turns AS turn_count FROM b WHERE role = 'assistant' AND turn % 3 <> 0")
def _(t):
    """Ends of asks: how long since the operator spoke, and the turns since then (W18, W19), from raw files (S08)."""
    return _normalised(t).where("kind = 'done'").select("session_id", "ts", "elapsed_ms", "turn_count")


@query("A45_session_usage", """
SELECT 'c' || conv_id AS session_id, CASE WHEN conv_id % 3 = 0 THEN 'openrouter' ELSE 'claude_code' END AS provider_kind, CAST(sum(turn + 1) FILTER (role = 'assistant') AS BIGINT) AS prompt_tokens, CAST(sum(turn) FILTER (role = 'assistant') AS BIGINT) AS cache_write_5m_tokens,
  CAST(sum(conv_id % 3) FILTER (role = 'assistant') AS BIGINT) AS cache_write_1h_tokens, 1767225600000 + conv_id * 1000 + 10000 * min(turn) FILTER (turn % 5 <> 4 OR role <> 'user') AS started_at_unix_ms,
  10000 * (max(turn) FILTER (turn % 5 <> 4 OR role <> 'user') - min(turn) FILTER (turn % 5 <> 4 OR role <> 'user')) AS wall_clock_ms
FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') > 0
""")
def _(t):
    """Sessions' usage with cache writes by lifetime, and the provider that the path tells (F11, F14)."""
    return _normalised(t).where("kind = 'task_telemetry'").select("session_id", "provider_kind", "prompt_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens", "started_at_unix_ms", "wall_clock_ms")


_OBS, _PRED = "round(CAST(100.0 AS DOUBLE) * net / greatest(n_user, 1), 1)", "CAST(n_user * 7 % 50 - 20 AS DOUBLE)"


@query("S16_probe_panels", f"""
WITH x AS (SELECT session_ref, {_OBS} AS obs, {_PRED} AS pred FROM ({{sentiment}}) AS s), y AS (SELECT *, round(pred - obs, 1) AS resid FROM x),
u AS (SELECT session_ref, CAST(NULL AS DOUBLE) AS obs, pred, CAST(NULL AS DOUBLE) AS resid FROM x)
SELECT * FROM (SELECT 'unnoticed' AS panel, row_number() OVER (ORDER BY -resid, session_ref) AS rank, * FROM y UNION ALL SELECT 'task_frust', row_number() OVER (ORDER BY resid, session_ref), * FROM y) AS a WHERE rank <= 12
UNION ALL SELECT * FROM (SELECT 'unattended' AS panel, row_number() OVER (ORDER BY pred, session_ref) AS rank, * FROM u) AS b WHERE rank <= 15
""".replace("{sentiment}", "SELECT fleet || ':' || session AS session_ref, count(*) AS n_user, 3 * count(*) FILTER (id % 4 = 0) - count(*) AS net FROM talk WHERE kind = 'user_message' GROUP BY 1"))
def _(t):
    """The probe's artifact over conversations, written, read back and split into its lists."""
    per = t.talk.where("kind = 'user_message'").groupBy(F.concat_ws(":", "fleet", "session").alias("session_ref")).agg(F.count("*").alias("n_user"), (3 * F.count_if(F.col("id") % 4 == 0) - F.count("*")).alias("net"))
    inter = per.withColumns({"obs": F.round(100.0 * F.col("net") / F.greatest("n_user", F.lit(1)), 1), "pred": F.round(F.col("n_user") * 7 % 50 - 20.0, 1)})
    at = new_folder(t.spark, "probe")
    meta = inter.agg(F.lit(None).cast("double").alias("r2"), F.avg(F.abs(F.col("pred") - F.col("obs"))).alias("mae"), F.count("*").alias("n_interactive"), F.count("*").alias("n_unattended"))
    artifacts.write_probe(meta, artifacts.probe_sessions(inter, inter.select("session_ref", "pred")), at)
    return artifacts.probe_panels(artifacts.read_probe(t.spark, at)[1])


@query("S14_findings_table", "SELECT fleet || ':' || session AS session_ref, id AS event_id, 'k ' || k || ' v' || v AS detail FROM ev WHERE kind = 'callout'")
def _(t):
    """Findings with tabs in their text, written as a table with a header and read back."""
    at = new_folder(t.spark, "tsv")
    rows = t.ev.where("kind = 'callout'").select(F.concat_ws(":", "fleet", "session").alias("session_ref"), F.col("id").alias("event_id"), F.format_string("k\t%d\nv%d", "k", "v").alias("detail"))
    artifacts.write_tsv(rows, at)
    return artifacts.read_tsv(t.spark, at, "session_ref string, event_id long, detail string")


@query("J22_incident_sessions", f"""
WITH {_MARKS}, i AS (SELECT DISTINCT CAST(CAST(make_timestamp(ts * 1000) AS DATE) AS VARCHAR) AS day, fleet || ':' || session AS session_ref FROM ev WHERE kind = 'callout' AND fleet = 'mu'),
lm AS (SELECT session_ref, rating FROM (SELECT *, row_number() OVER (PARTITION BY session_ref ORDER BY created_ms DESC, id DESC) AS r FROM mk) AS x WHERE r = 1)
SELECT day, 'callouts' AS slug, 'issue' AS polarity, session_ref, rating IS NOT NULL OR session_ref IN (SELECT fleet || ':' || session FROM ev WHERE kind = 'done') AS known, rating FROM i LEFT JOIN lm USING (session_ref)
""".replace("rating IS NOT NULL OR ", ""))
def _(t):
    """A report for each day that names its sessions with callouts, every second one with a slash; known are sessions that ended."""
    from tracewell.operators.stores import latest_marks

    named = t.ev.where("kind = 'callout' and fleet = 'mu'").select(F.to_date(F.timestamp_millis("ts")).alias("day"), F.when(F.col("id") % 2 == 0, F.concat_ws("/", F.concat(F.lit("mu:"), "daemon"), "session_id")).otherwise(F.concat_ws(":", F.lit("mu"), "daemon", "session_id")).alias("ref"))
    files = named.groupBy("day").agg(F.array_join(F.collect_list("ref"), " and ").alias("refs")).select(F.format_string("/notes/incident-%s-callouts.md", F.col("day").cast("string")).alias("path"), F.concat(F.lit("# Callouts\nSee "), "refs", F.lit(".\n")).alias("text"))
    known = t.ev.where("kind = 'done'").select(F.concat_ws(":", "fleet", "session").alias("session_ref"))
    marks = latest_marks(_marks(t, "true"), _marks(t, "false")).select("session_ref", "rating")
    return shapes.incident_sessions(reports.incidents(files, {"incident": "issue"}), known, marks).withColumn("day", F.col("day").cast("string"))


@query("U04_widened_union", """
SELECT session, CAST(k AS DOUBLE) AS n, CAST(k AS VARCHAR) AS mixed, v AS only_mu, CAST(NULL AS BOOLEAN) AS only_cc FROM ev WHERE kind = 'task_telemetry' AND fleet = 'mu'
UNION ALL SELECT session, v / 4.0, 'k' || k, NULL, k % 2 = 0 FROM ev WHERE kind = 'task_telemetry' AND fleet = 'cc'
""")
def _(t):
    """Two sinks whose columns are of different types or missing."""
    tel = t.ev.where("kind = 'task_telemetry'")
    mu = tel.where("fleet = 'mu'").select("session", F.col("k").cast("int").alias("n"), F.col("k").alias("mixed"), F.col("v").alias("only_mu"))
    cc = tel.where("fleet = 'cc'").select("session", (F.col("v") / 4.0).alias("n"), F.concat(F.lit("k"), "k").alias("mixed"), (F.col("k") % 2 == 0).alias("only_cc"))
    return shapes.widened_union([mu, cc])


@query("F08_arguments", """
SELECT session, id, CASE WHEN id % 6 IN (0, 1) THEN coalesce(file_path, '') WHEN id % 6 = 3 THEN '{"path": ' || id WHEN id % 6 = 4 THEN 'ls ' || id ELSE '' END AS file,
  CASE WHEN id % 6 = 2 THEN coalesce(command, '') WHEN id % 6 = 3 THEN '{"path": ' || id WHEN id % 6 = 4 THEN 'ls ' || id ELSE '' END AS command FROM ev WHERE kind = 'tool_call'
""")
def _(t):
    """Tool calls whose arguments are objects under several keys, broken JSON, raw text, or a JSON text."""
    six = F.col("id") % 6
    one = lambda key, c: F.to_json(F.struct(F.lit("").alias("file_path"), F.lit(0).alias("cmd_count"), F.col(c).alias(key))) if key != "file_path" else F.to_json(F.struct(F.col(c).alias(key)))
    args: Column = F.when(six == 0, one("file_path", "file_path")).when(six == 1, one("notebook_path", "file_path")).when(six == 2, F.to_json(F.struct(F.lit("").alias("command"), F.col("command").alias("cmd"))))
    args = args.when(six == 3, F.concat(F.lit('{"path": '), "id")).when(six == 4, F.concat(F.lit("ls "), "id")).otherwise(F.lit('"quoted"'))
    rows = t.ev.where("kind = 'tool_call'").withColumn("a", args)
    return rows.select("session", "id", shapes.file_argument(F.col("a")).alias("file"), shapes.command_argument(F.col("a")).alias("command"))


@query("P06_real_models", "WITH f AS (SELECT fleet, session, arg_min(coalesce(model, ''), id) AS m FROM ev WHERE kind = 'session_created' GROUP BY ALL) SELECT fleet, session, count(*) AS events FROM ev WHERE (fleet, session) NOT IN (SELECT (fleet, session) FROM f WHERE m = 'faux') GROUP BY ALL")
def _(t):
    """Events of sessions that weren't created with the tests' model."""
    return shapes.without_stamped(t.ev).groupBy("fleet", "session").agg(F.count("*").alias("events"))


@query("J21_labelled", "SELECT DISTINCT fleet || ':' || session AS session_ref, fleet || ':' || session IN (SELECT fleet || ':' || session FROM ev WHERE kind = 'operator_mark') AS labelled FROM ev WHERE kind = 'task_telemetry'")
def _(t):
    ref = F.concat_ws(":", "fleet", "session").alias("session_ref")
    return shapes.labelled(t.ev.where("kind = 'task_telemetry'").select(ref).distinct(), t.ev.where("kind = 'operator_mark'").select(ref))


@query("T06_sentiment_order", "SELECT * FROM (SELECT fleet || ':' || session AS session_ref, count(*) AS n_user FROM talk WHERE kind = 'user_message' AND meta IS NULL GROUP BY 1) AS s WHERE n_user >= 2")
def _(t):
    """Sessions in the order of the dumps, the least pleased first."""
    return scans.in_order(scans.sentiment(t.talk), "sentiment").select("session_ref", "n_user")


_LOGGED = """
SELECT session, kind, count(*) AS events, min(ts) AS first_ms, max(model) AS model, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens FROM ev WHERE fleet = 'mu' AND id % 50 <> 0 GROUP BY session, kind
"""


def _logs(t: Tables) -> str:
    """mu's events as log files, each fiftieth as a line that is cut off."""
    root = new_folder(t.spark, "logs")
    mine = t.ev.where("fleet = 'mu'")
    events.write_logs(mine.where("id % 50 <> 0"), root)
    mine.where("id % 50 = 0").select(F.lit('{"id": 1, "session_id"').alias("value"), F.col("daemon").alias("d")).write.partitionBy("d").mode("append").text(root)
    return root


def _of_logs(rows: DataFrame) -> DataFrame:
    wide = events.typed(rows.withColumns({c: F.regexp_replace(c, "^d=", "") for c in ("daemon", "session")}))
    return wide.groupBy("session", "kind").agg(F.count("*").alias("events"), F.min("ts").alias("first_ms"), F.max("model").alias("model"), F.sum("prompt_tokens").alias("prompt_tokens"))


@query("S01_read_logs", _LOGGED)
def _(t):
    """Log files read back, broken lines left out, the daemon from the path (S02)."""
    return _of_logs(events.read_events(t.spark, f"{_logs(t)}/*/*", "mu"))


@query("R01_ingested_logs", _LOGGED)
def _(t):
    """The same files taken in by a stream, whose checkpoint knows what was read (R02)."""
    at = new_folder(t.spark, "ingest")
    stream = jobs.event_stream(t.spark, _logs(t), "mu").where("id is not null")
    for _ in range(2):  # the second run finds nothing new
        jobs.run_once(stream, f"{at}/rows", f"{at}/checkpoint")
    return _of_logs(t.spark.read.schema(stream.schema).parquet(f"{at}/rows"))


@query("S10_task_sinks", f"WITH {_TASKS} SELECT fleet, count(*) AS tasks, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens FROM tasks GROUP BY fleet")
def _(t):
    """The task table written as a sink and read back by label, one label having no sink."""
    at = new_folder(t.spark, "sink")
    events.write_tasks(sessions.tasks(t.ev), at)
    found = events.read_tasks(t.spark, {"mu": f"{at}/fleet=mu", "cc": f"{at}/fleet=cc", "none": f"{at}/fleet=none"}, "task_id string, prompt_tokens long")
    return found.groupBy("fleet").agg(F.count("*").alias("tasks"), F.sum("prompt_tokens").alias("prompt_tokens"))


def _billed(t: Tables) -> DataFrame:
    """Telemetry as days of billed usage: a result for each task, its amount in cents as text."""
    cache = F.struct(F.col("cache_write_5m_tokens").alias("ephemeral_5m_input_tokens"), F.col("cache_write_1h_tokens").alias("ephemeral_1h_input_tokens"))
    result = F.struct("model", F.col("prompt_tokens").alias("uncached_input_tokens"), F.col("completion_tokens").alias("output_tokens"), F.col("cache_read_tokens").alias("cache_read_input_tokens"), cache.alias("cache_creation"), F.when(F.col("k") % 9 == 0, "n/a").otherwise(F.col("k").cast("string")).alias("amount"))
    days = t.ev.where("kind = 'task_telemetry'").withColumn("hour", F.date_format(F.date_trunc("hour", F.timestamp_millis("ts")), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return days.groupBy(F.col("hour").alias("starting_at")).agg(F.collect_list(result).alias("results"))


_USAGE = """bu AS (SELECT CAST(CAST(make_timestamp(ts * 1000) AS DATE) AS VARCHAR) AS day, model, prompt_tokens AS i, completion_tokens AS o, cache_read_tokens AS r, cache_write_5m_tokens AS w5, cache_write_1h_tokens AS w1, CASE WHEN k % 9 = 0 THEN 0.0 ELSE k / 100.0 END AS usd,
  CASE WHEN contains(lower(model), 'opus') THEN 5.0 WHEN contains(lower(model), 'sonnet') THEN 3.0 WHEN contains(lower(model), 'haiku') THEN 1.0 ELSE 0.0 END AS price FROM ev WHERE kind = 'task_telemetry')"""


@query("A61_billed_usage", f"""
WITH {_USAGE} SELECT day, model, CAST(sum(i) AS BIGINT) AS uncached_input, CAST(sum(o) AS BIGINT) AS output, round(sum(((i + 1.25 * w5 + 2.0 * w1 + 0.1 * r) * price + o * price * 5) / 1e6), 9) AS list_usd, round(sum(usd), 6) AS billed_usd FROM bu GROUP BY day, model
""")
def _(t):
    """Billed usage by day and model, at list price and as billed (S23)."""
    return reports.billed_usage(_billed(t)).select(F.col("day").cast("string").alias("day"), "model", "uncached_input", "output", F.round("list_usd", 9).alias("list_usd"), F.round("billed_usd", 6).alias("billed_usd"))


@query("J23_billed_and_computed", f"""
WITH {_USAGE}, {_TASKS}, b AS (SELECT day, sum(usd) AS usd FROM bu GROUP BY day), c AS (SELECT CAST(day AS VARCHAR) AS day, sum(cost) AS cost FROM tasks GROUP BY 1)
SELECT coalesce(b.day, c.day) AS day, round(coalesce(usd, 0.0), 6) AS billed_usd, round(coalesce(cost, 0.0), 4) AS cost FROM b FULL JOIN c ON b.day = c.day
""")
def _(t):
    tasks = sessions.tasks(t.ev).withColumn("cost", to_grid(F.col("cost")))
    out = reports.reconciled(reports.billed_usage(_billed(t)), tasks)
    return out.select(F.col("day").cast("string").alias("day"), F.round("billed_usd", 6).alias("billed_usd"), F.round("cost", 4).alias("cost"))


@query("F31_judges_replies", "SELECT session, id, CASE k % 3 WHEN 0 THEN v % 2 = 0 END AS occurred, CASE k % 3 WHEN 0 THEN 'high' END AS severity FROM ev WHERE kind = 'tool_result'")
def _(t):
    """Replies with an object in prose, cut off, or without one."""
    good = F.format_string('Sure:\n{"occurred": %s, "severity": "high", "summary": "a {b} c"}\nDone.', (F.col("v") % 2 == 0).cast("string"))
    reply = F.when(F.col("k") % 3 == 0, good).when(F.col("k") % 3 == 1, '{"occurred": tru').otherwise("no idea")
    rows = t.ev.where("kind = 'tool_result'").select("session", "id", reports.parsed_verdict(reply).alias("r"))
    return rows.select("session", "id", "r.occurred", "r.severity")


@query("W12_gap_messages", """
WITH m AS (SELECT fleet, session, id, ts, left(coalesce(content, ''), 400) AS after FROM ev WHERE kind = 'user_message' AND meta IS NULL),
g AS (SELECT fleet, session, id, (ts - lag(ts) OVER w) / 3600000.0 AS hours, lag(after, 2) OVER w AS before_1, lag(after) OVER w AS before_2, after FROM m WINDOW w AS (PARTITION BY fleet, session ORDER BY id)) SELECT * FROM g WHERE hours >= 3.0
""")
def _(t):
    return reports.gap_messages(t.ev)


@query("A48_context_bands", f"""
WITH p AS (SELECT fleet, session, count(*) FILTER (kind = 'user_message' AND meta IS NULL) AS messages, coalesce(sum(len(regexp_extract_all(coalesce(content, ''), {_any(NEGATIVE)}))) FILTER (kind = 'user_message' AND meta IS NULL), 0) AS hits, max(token_count) AS context FROM ev GROUP BY ALL)
SELECT CASE WHEN context IS NULL THEN '?' WHEN context < 2000 THEN 'S' WHEN context < 4000 THEN 'M' ELSE 'L' END AS band, count(*) AS sessions, avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END) AS presence, 1000.0 * sum(hits) / sum(messages) AS per_1000 FROM p WHERE messages > 0 GROUP BY 1
""")
def _(t):
    return reports.context_bands(t.ev)


@query("A44_host_rates", f"WITH {_FLAGS}, {_UNPIVOT}, ho AS (SELECT DISTINCT fleet, session, 'h' || right(daemon, 1) AS host FROM ev) SELECT predicate, fleet, host, count(*) AS sessions, count(*) FILTER (fired) AS fired, avg(CAST(fired AS DOUBLE)) AS rate FROM un LEFT JOIN ho USING (fleet, session) WHERE exposed GROUP BY GROUPING SETS ((predicate), (predicate, fleet), (predicate, fleet, host))")
def _(t):
    """At-risk rates down to the host of a session's log."""
    hosts = t.ev.select("fleet", "session", F.concat(F.lit("h"), F.right("daemon", F.lit(1))).alias("host")).distinct()
    return toolstream.at_risk_rates(toolstream.violations(t.ev), hosts)


@query("A60_subscription_spend", """
WITH p AS (SELECT daemon AS name, CAST(20 AS DOUBLE) AS usd, CAST(make_timestamp(min(ts) * 1000) AS DATE) AS a, CAST(make_timestamp(max(ts) * 1000) AS DATE) AS b FROM ev GROUP BY daemon, session)
SELECT name, round(sum(CASE WHEN a BETWEEN DATE '2024-01-08' AND DATE '2024-01-21' THEN usd ELSE 0.0 END), 6) AS calendar_usd, round(sum(usd * greatest(0, datediff('day', greatest(a, DATE '2024-01-08'), least(b, DATE '2024-01-21')) + 1) / (datediff('day', a, b) + 1)), 6) AS amortised_usd FROM p GROUP BY name
""")
def _(t):
    """Each session's span as a subscription of 20 USD, over two weeks."""
    day = lambda c: F.to_date(F.timestamp_millis(c))
    plans = t.ev.groupBy(F.col("daemon").alias("name"), "session").agg(F.lit(20.0).alias("usd"), day(F.min("ts")).alias("from_day"), day(F.max("ts")).alias("to_day"))
    out = reports.spend(plans, F.lit("2024-01-08").cast("date"), F.lit("2024-01-21").cast("date"))
    return out.select("name", F.round("calendar_usd", 6).alias("calendar_usd"), F.round("amortised_usd", 6).alias("amortised_usd"))
