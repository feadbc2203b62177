"""Queries that run a stream over a table to its end and give what it kept. Their SQL is the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.plans.registry import Tables, query
from tracewell.sources import adapters
from tracewell.sources.shared import new_folder
from tracewell.streaming import inbox, jobs, records, workers
from tracewell.streaming.tables import KeyedTable, upsert_stream

HOUR_MS = 3_600_000


def _ev(t: Tables) -> DataFrame:
    return adapters.events(t.spark, t.sf_dir, stream=True)


def _run(t: Tables, stream: DataFrame, name: str) -> DataFrame:
    """What a stream appends until all that is there has been read."""
    at = new_folder(t.spark, name)
    jobs.run_once(stream, f"{at}/rows", f"{at}/checkpoint")
    return t.spark.read.schema(stream.schema).parquet(f"{at}/rows")


@query("R04_daily_degradation", """
SELECT CAST(CAST(make_timestamp(ts * 1000) AS DATE) AS VARCHAR) AS day, count(*) AS n, avg(CASE WHEN stop_reason IN ('aborted', 'degraded_eof', 'error', 'iteration_cap', 'max_tokens') THEN 1.0 ELSE 0.0 END) AS rate FROM ev WHERE kind = 'done' GROUP BY 1
""")
def _(t):
    """Days are sent again when they change (update mode) and kept by key."""
    at = new_folder(t.spark, "daily")
    table = KeyedTable(t.spark, f"{at}/days", ["day"])
    events = _ev(t).withColumn("payload", F.to_json(F.struct("stop_reason")))
    upsert_stream(jobs.daily_degradation(events).withColumn("day", F.col("day").cast("string")), table, [], f"{at}/checkpoint", "update").awaitTermination()
    return table.read()


@query("R05_inactivity_sessions", f"""
WITH g AS (SELECT fleet, session, ts, CASE WHEN ts - lag(ts) OVER w > {12 * HOUR_MS} THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY fleet, session ORDER BY ts)),
s AS (SELECT fleet, session, ts, sum(new) OVER (PARTITION BY fleet, session ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g),
x AS (SELECT fleet, session, min(ts) AS start_ms, max(ts) + {12 * HOUR_MS} AS end_ms, count(*) AS events FROM s GROUP BY fleet, session, n)
SELECT fleet, session, start_ms, end_ms, events FROM x WHERE end_ms <= (SELECT max(ts) FROM ev) - {HOUR_MS}
""")
def _(t):
    """Stretches without a pause of half a day; those that may still go on are not given."""
    out = _run(t, jobs.inactivity_sessions(_ev(t), "12 hours", "1 hour"), "inactivity")
    return out.select("fleet", "session", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "events")


@query("R06_turns", """
WITH a AS (SELECT fleet, session, id, ts, kind, count(*) FILTER (kind = 'user_message') OVER (PARTITION BY fleet, session ORDER BY id ROWS UNBOUNDED PRECEDING) AS turn FROM ev WHERE kind IN ('user_message', 'done', 'assistant_message_event')),
b AS (SELECT *, count(*) FILTER (kind = 'done') OVER (PARTITION BY fleet, session, turn ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended, max(turn) OVER (PARTITION BY fleet, session) AS final FROM a WHERE turn > 0)
SELECT fleet, session, min(ts) FILTER (kind = 'user_message') AS start_ms, max(ts) FILTER (kind <> 'user_message') AS end_ms, count(*) FILTER (kind = 'assistant_message_event') AS invocations FROM b WHERE ended = 0
GROUP BY fleet, session, turn, final HAVING count(*) FILTER (kind = 'assistant_message_event') > 0 AND (turn < final OR count(*) FILTER (kind = 'done') > 0)
""")
def _(t):
    """Turns that ended: another message or `done` followed."""
    return _run(t, jobs.turns(_ev(t)), "turns")


_WORKERS = "kind IN ('worker_spawned', 'worker_exited', 'worker_failed', 'worker_timeout')"


@query("R07_stale_workers", f"""
WITH s AS (SELECT fleet, session, ts, model, row_number() OVER (PARTITION BY fleet, session ORDER BY id) AS n FROM ev WHERE kind = 'worker_spawned'),
e AS (SELECT fleet, session, replace(kind, 'worker_', '') AS ended, elapsed_ms AS took, row_number() OVER (PARTITION BY fleet, session ORDER BY id) AS n FROM ev WHERE {_WORKERS} AND kind <> 'worker_spawned')
SELECT fleet, session, n, ts, model, coalesce(ended, 'unknown-stale') AS outcome, took FROM s LEFT JOIN e USING (fleet, session, n)
WHERE ended IS NOT NULL OR ts + {6 * HOUR_MS} <= (SELECT max(ts) FROM ev WHERE {_WORKERS}) - {HOUR_MS}
""")
def _(t):
    """Workers that ended, or of which nothing was heard for six hours; the clock is the workers' events, less an hour."""
    return workers.latest_outcomes(_run(t, workers.outcomes(_ev(t)), "workers"))


def _usage_records(t: Tables) -> DataFrame:
    """Conversations as a stream of transcript records: each answer in two records, the later one with more usage."""
    part = F.explode(F.when(F.col("role") == "assistant", F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0))))
    rows = adapters.table(t.spark, t.sf_dir, "conversations", stream=True).select("conv_id", "turn", "role", part.alias("part"))
    usage = F.struct(((F.col("conv_id") % 7 + F.col("turn")) * (1 + F.col("part"))).alias("input_tokens"), (F.col("turn") * 3 + F.col("part")).alias("output_tokens"), F.struct((F.col("turn") * F.col("part")).alias("ephemeral_1h_input_tokens")).alias("cache_creation"))
    message = F.to_json(F.struct(F.format_string("m%d-%d", "conv_id", "turn").alias("id"), usage.alias("usage")))
    return rows.select(F.format_string("c%d", "conv_id").alias("session_id"), (F.col("turn") * 2 + F.col("part")).cast("long").alias("pos"), F.col("role").alias("type"), message.alias("message"))


_TOTALS = """
SELECT 'c' || conv_id AS session_id, count(*) AS messages, CAST(sum((conv_id % 7 + turn) * 2) AS BIGINT) AS prompt_tokens, CAST(sum(turn * 3 + 1) AS BIGINT) AS completion_tokens, CAST(sum(turn) AS BIGINT) AS cache_write_1h_tokens FROM conversations WHERE role = 'assistant' GROUP BY conv_id
"""
_KEPT = ("session_id", "messages", "prompt_tokens", "completion_tokens", "cache_write_1h_tokens")


@query("R03_streamed_records", _TOTALS)
def _(t):
    """The sum of differences is the total by last records."""
    return records.session_totals(_run(t, records.usage_changes(_usage_records(t)), "changes")).select(*_KEPT)


@query("R08_session_totals", _TOTALS)
def _(t):
    """The same totals, kept as a table that takes only what changed."""
    at = new_folder(t.spark, "totals")
    changes = records.usage_changes(_usage_records(t))
    jobs.run_once(changes, f"{at}/changes", f"{at}/first")
    table = KeyedTable(t.spark, f"{at}/table", ["session_id"])
    records.keep_totals(t.spark.readStream.schema(changes.schema).parquet(f"{at}/changes"), table, f"{at}/second")
    return table.read().select(*_KEPT)


@query("R09_marks_inbox", """
WITH m AS (SELECT CASE WHEN id % 3 = 0 THEN 'm' || id % 40 ELSE 'm' || id END AS mark_id, CASE WHEN rating = '4' THEN 4 WHEN rating = '0' THEN 1 WHEN rating = '9' THEN 5 WHEN rating = '2.7' THEN 2 ELSE 3 END AS rating, 'n' || id AS note, ts AS created_ms,
  CASE WHEN id % 2 = 0 THEN 'mu:' || daemon || ':' || session_id ELSE 'cc:' || session_id END AS session_ref, id FROM ev WHERE kind = 'operator_mark')
SELECT mark_id, rating, note, created_ms, session_ref FROM (SELECT *, row_number() OVER (PARTITION BY mark_id ORDER BY created_ms DESC, note DESC) AS r FROM m) AS x WHERE r = 1
""")
def _(t):
    """Marks of the event log as an inbox's files, with a broken line beside each tenth mark."""
    at = new_folder(t.spark, "inbox")
    rows = t.ev.where("kind = 'operator_mark'").withColumn("mark", F.when(F.col("id") % 3 == 0, F.col("id") % 40).otherwise(F.col("id")))
    line = F.to_json(F.struct(F.format_string("m%d", "mark").alias("task_id"), "rating", F.format_string("n%d", "id").alias("note"), "session_id", F.when(F.col("id") % 2 == 0, F.col("daemon")).alias("daemon"), F.col("ts").alias("created_at_unix_ms")))
    lines = rows.select(F.explode(F.when(F.col("id") % 10 == 0, F.array(line, F.lit('{"broken'))).otherwise(F.array(line))).alias("value"))
    lines.write.text(f"{at}/in", lineSep="\n")
    store, broken = KeyedTable(t.spark, f"{at}/marks", inbox.KEY), KeyedTable(t.spark, f"{at}/broken", ["file"])
    inbox.ingest(t.spark, f"{at}/in", None, store, broken, f"{at}/checkpoint", names="*.txt")
    return store.read().select("mark_id", "rating", "note", "created_ms", "session_ref")
