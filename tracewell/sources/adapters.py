"""Adapters of generic tables to the event model: pure expressions, in SQL that Spark and other engines read alike.

events_sql() gives an `ev` relation from events(event_id, ts, user_id, event_type, value, props): a user's week is a session,
and payload fields follow by integer arithmetic from the property k and from the value in cents. talk_sql() gives one from
conversations(conv_id, turn, role, text), each message ending in a phrase from a fixed list, so that every marker occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

WEEK_MS = 7 * 86_400_000
EPOCH_MS = 1_704_067_200_000

MODELS = ("claude-opus-4-8", "claude-sonnet-4-6-20251001", "anthropic/claude-haiku-4-5", "gpt-5.4-mini", "unlisted-model", "faux", "claude-opus-4-7")
PROVIDERS = ("anthropic_api", "openrouter", "openai_codex", "claude_code", "ollama")
STOPS = ("end_turn", "tool_use", "end_turn", "max_tokens", "aborted", "degraded_eof", "end_turn", "error", "iteration_cap", "end_turn")
OUTCOMES = ("completed", "narrative_no_action", "hollow_commit", "completed", "lying_state", "partial")
TOOLS = ("Read", "bash", "Edit", "grep", "mcp__files__Read", "Write", "shell", "web-fetch")
COMMANDS = ("ls -la", "cat <<EOF > notes.txt", "python3 - <<PY", "rm -rf build", "git push --force origin main", "echo done", "git status", "dd if=a of=b", "git reset --hard", "wc -l x")
FILES = ("src/a.py", "src/b.py", "README.md")
PHRASES = (
    "and so on.", "you keep doing this, stop", "great work, thanks!", "I've updated the file.", "let me check that", "no. that's not what I asked for",
    "looks good, perfect", "why are you guessing?", "we have fixed it", "that works", "wtf, wrong again", "goodnight and thank you", "I'll run the tests", "please don't do that again?",
)


def _pick(values: tuple[str, ...], index: str) -> str:
    quoted = [v.replace("'", "''") for v in values]
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(quoted))
    return f"(CASE ({index}) % {len(values)} {whens} END)"


def events_sql(millis: str, k: str) -> str:
    """millis, k: the engine's expressions for the milliseconds of ts and the integer k of props."""
    tel, done, call = "kind = 'task_telemetry'", "kind = 'done'", "kind = 'tool_call'"
    return f"""
SELECT id, fleet, daemon, session_id, CASE WHEN fleet = 'mu' THEN daemon || ':' || session_id ELSE session_id END AS session,
  ts, kind, k, v, {_pick(PROVIDERS, "uid + w")} AS provider_raw,
  CASE WHEN kind IN ('task_telemetry', 'session_created', 'worker_spawned') THEN {_pick(MODELS, "k")} END AS model,
  CASE WHEN {tel} THEN {_pick(PROVIDERS, "uid + w")} END AS provider,
  CASE WHEN {tel} THEN (CASE WHEN fleet = 'cc' THEN 'cc-' || session_id ELSE 't-' || CAST(id AS STRING) END) END AS task_id,
  CASE WHEN {tel} THEN (CASE WHEN k % 9 = 0 THEN 'error' WHEN k % 9 = 1 THEN 'cancelled' ELSE 'completed' END) END AS exit_reason,
  CASE WHEN {tel} AND k % 11 <> 0 THEN {_pick(OUTCOMES, "k")} END AS outcome_class,
  CASE WHEN {tel} THEN v * 3 + k END AS prompt_tokens,
  CASE WHEN {tel} THEN v + 7 * k END AS completion_tokens,
  CASE WHEN {tel} THEN v * 10 END AS cache_read_tokens,
  CASE WHEN {tel} THEN v * 2 END AS cache_write_tokens,
  CASE WHEN {tel} THEN v END AS cache_write_5m_tokens,
  CASE WHEN {tel} THEN v END AS cache_write_1h_tokens,
  CASE WHEN {done} OR kind = 'worker_exited' THEN v * 5 + k END AS elapsed_ms,
  CASE WHEN {done} THEN {_pick(STOPS, "k")} END AS stop_reason,
  CASE WHEN {call} THEN {_pick(TOOLS, "k")} END AS tool_name,
  CASE WHEN {call} AND k % 8 IN (1, 6) THEN {_pick(COMMANDS, "v")} END AS command,
  CASE WHEN {call} AND k % 8 IN (0, 2, 4, 5) THEN {_pick(FILES, "v")} END AS file_path,
  CASE WHEN kind = 'tool_result' THEN k % 3 = 0 END AS is_error,
  CASE WHEN kind = 'user_message' THEN {_pick(PHRASES, "k + v")} WHEN kind IN ('callout', 'autonomous_terminated') THEN 'flag ' || CAST(k AS STRING) END AS content,
  CASE WHEN kind = 'user_message' AND k % 10 = 0 THEN 'true' END AS meta,
  CASE WHEN kind IN ('assistant_message_event', 'context_assembly') THEN 1000 + v * 4 END AS token_count,
  CASE WHEN kind = 'assistant_message_event' THEN v END AS output_tokens,
  CASE WHEN kind = 'provider_status_update' THEN (CASE WHEN k % 2 = 0 THEN 'awaiting_first_token' ELSE 'streaming' END) END AS state,
  CASE WHEN kind = 'compaction_assembly' THEN 60000 + v END AS tokens_before,
  CASE WHEN kind = 'compaction_assembly' THEN 20000 + v END AS tokens_after,
  CASE WHEN kind = 'compaction_assembly' THEN {_pick(("kept", "dropped", "summarized"), "k")} END AS action,
  CASE WHEN kind = 'recall_provenance' THEN {_pick(("project_file", "filesystem", "memory", "bootloader", "other_source"), "v")} END AS recall_source,
  CASE WHEN kind = 'recall_provenance' THEN v END AS recall_tokens,
  CASE WHEN kind LIKE 'mailbox%' THEN {_pick(("note", "task", "reply"), "v")} END AS message_kind,
  CASE WHEN kind = 'operator_mark' THEN {_pick(("4", "0", "9", "abc", "2.7"), "k")} END AS rating
FROM (
  SELECT id, uid, w, k, v, ts, CASE WHEN uid % 2 = 0 THEN 'mu' ELSE 'cc' END AS fleet, 'd' || CAST(uid % 10 AS STRING) AS daemon,
    'u' || CAST(uid AS STRING) || '-w' || CAST(w AS STRING) AS session_id,
    CASE WHEN event_type = 'signup' AND k % 10 = 9 THEN 'session_created'
         WHEN event_type = 'signup' AND k % 10 = 8 THEN 'operator_mark'
         WHEN event_type = 'signup' THEN 'user_message'
         WHEN event_type = 'view' AND k % 10 = 9 THEN 'context_assembly'
         WHEN event_type = 'view' AND k % 10 IN (7, 8) THEN 'provider_status_update'
         WHEN event_type = 'view' AND k % 10 = 6 THEN 'recall_provenance'
         WHEN event_type = 'view' THEN 'assistant_message_event'
         WHEN event_type = 'click' AND k % 4 = 3 THEN 'tool_result'
         WHEN event_type = 'click' THEN 'tool_call'
         WHEN event_type = 'error' AND k % 20 = 19 THEN 'compaction_assembly'
         WHEN event_type = 'error' AND k % 20 = 18 THEN 'callout'
         WHEN event_type = 'error' AND k % 20 IN (16, 17) THEN 'worker_spawned'
         WHEN event_type = 'error' AND k % 20 = 15 THEN 'worker_exited'
         WHEN event_type = 'error' AND k % 20 = 14 THEN 'worker_failed'
         WHEN event_type = 'error' AND k % 20 = 13 THEN 'mailbox_message_posted'
         WHEN event_type = 'error' AND k % 20 = 12 THEN 'mailbox_message_consumed'
         WHEN event_type = 'error' AND k % 20 = 11 THEN 'autonomous_terminated'
         WHEN event_type = 'error' THEN 'done'
         ELSE 'task_telemetry' END AS kind
  FROM (
    SELECT event_id AS id, user_id AS uid, event_type, {millis} AS ts, CAST(floor(({millis} - {EPOCH_MS}) / {WEEK_MS}.0) AS BIGINT) AS w, {k} AS k, CAST(round(value * 100) AS BIGINT) AS v
    FROM events
  ) AS a
) AS b
"""


def talk_sql() -> str:
    return f"""
SELECT turn AS id, CASE WHEN conv_id % 2 = 0 THEN 'mu' ELSE 'cc' END AS fleet, 'd' || CAST(conv_id % 5 AS STRING) AS daemon, 'c' || CAST(conv_id AS STRING) AS session_id,
  CASE WHEN conv_id % 2 = 0 THEN 'd' || CAST(conv_id % 5 AS STRING) || ':c' || CAST(conv_id AS STRING) ELSE 'c' || CAST(conv_id AS STRING) END AS session,
  {EPOCH_MS} + conv_id * 7200000 + turn * 60000 AS ts,
  CASE WHEN role = 'assistant' THEN 'assistant_message_event' ELSE 'user_message' END AS kind,
  CASE WHEN role = 'system' THEN 'true' END AS meta,
  coalesce(text, '') || ' ' || {_pick(PHRASES, "conv_id * 7 + turn")} AS content,
  CASE WHEN role = 'assistant' THEN {_pick(TOOLS, "conv_id + turn")} END AS tool_name,
  CASE WHEN role = 'assistant' AND (conv_id + turn) % 8 IN (1, 6) THEN {_pick(COMMANDS, "conv_id * 3 + turn")} END AS command,
  (conv_id + turn) % 3 = 0 AS has_tool
FROM conversations
"""


SPARK_MILLIS, SPARK_K = "unix_millis(CAST(ts AS TIMESTAMP))", "CAST(get_json_object(props, '$.k') AS BIGINT)"
DUCK_MILLIS, DUCK_K = "(epoch_us(ts) // 1000)", "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def table(spark: SparkSession, sf_dir: str, name: str, stream: bool = False) -> DataFrame:
    """A table, or a stream of its rows."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # A stream takes a single file by a glob only.
    return spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/{name}.parque[t]") if stream else rows


def events(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    table_ = table(spark, sf_dir, "events", stream)
    return spark.sql(events_sql(SPARK_MILLIS, SPARK_K).replace("FROM events\n", "FROM {events}\n"), events=table_)


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(talk_sql().replace("FROM conversations", "FROM {conversations}"), conversations=spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: Common table expressions for the same relations in DuckDB.
DUCK_PREFIX = f"ev AS ({events_sql(DUCK_MILLIS, DUCK_K)}), talk AS ({talk_sql()})"
