"""Raw transcripts to events: streamed records are made one, content blocks become events in order, and each session ends in
its telemetry. All of it is set operations; no file is walked by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tags that open text which the harness put in, and how stop reasons are named.
INJECTED = ("command-name", "command-message", "command-args", "local-command-stdout", "local-command-caveat", "system-reminder", "task-notification", "bash-input", "bash-stdout", "bash-stderr")
STOPS = {"tool_use": "tool_use", "end_turn": "end_turn", "max_tokens": "max_tokens", "stop_sequence": "end_turn"}

USAGE = "input_tokens bigint, output_tokens bigint, cache_read_input_tokens bigint, cache_creation_input_tokens bigint, cache_creation struct<ephemeral_5m_input_tokens bigint, ephemeral_1h_input_tokens bigint>"
MESSAGE = f"id string, role string, model string, stop_reason string, content string, usage struct<{USAGE}>"
BLOCKS = "array<struct<type string, text string, thinking string, id string, name string, input string, tool_use_id string, content string, is_error boolean>>"
TOKENS = {
    "input_tokens": "prompt_tokens", "output_tokens": "completion_tokens", "cache_read_input_tokens": "cache_read_tokens", "cache_creation_input_tokens": "cache_write_tokens",
    "cache_creation.ephemeral_5m_input_tokens": "cache_write_5m_tokens", "cache_creation.ephemeral_1h_input_tokens": "cache_write_1h_tokens",
}
#: What an event may carry besides session_id, id, ts and kind; each kind fills its own.
FIELDS = {
    "content": "string", "meta": "string", "call_id": "string", "name": "string", "arguments": "string", "is_error": "boolean", "stop_reason": "string", "model": "string", **dict.fromkeys(TOKENS.values(), "bigint"),
    "elapsed_ms": "bigint", "turn_count": "bigint", "provider_kind": "string", "task_id": "string", "exit_reason": "string", "started_at_unix_ms": "bigint", "ended_at_unix_ms": "bigint", "wall_clock_ms": "bigint",
}
#: What marks a path of the provider that bills each token, and the providers' names.
BILLED_PATH, BILLED, SUBSCRIBED = "/.claude-openrouter/", "openrouter", "claude_code"
RECORD = "type string, timestamp string, isMeta boolean, message string, sessionId string"


def provider_of(path: Column) -> Column:
    """The provider that a transcript's path tells."""
    return F.when(path.contains(BILLED_PATH), BILLED).otherwise(SUBSCRIBED)


def read_records(spark, paths, stream: bool = False, **options) -> DataFrame:
    """Transcript files (JSON lines) as records: session_id, pos (the line), type, timestamp, isMeta, message, provider, path and
    named_session. A file is one session, which its name tells; where several share a file, named_session, which the records
    hold, tells them apart. Lines that are no JSON object are left out. A file is read as one text, so that lines keep
    their numbers; files of transcripts are small, and there are many."""
    reader = (spark.readStream if stream else spark.read).options(**options)
    files = reader.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"), F.regexp_replace("_metadata.file_name", r"\.jsonl$", "").alias("session_id"))
    lines = files.select("session_id", "path", F.posexplode(F.split("value", "\n")).alias("pos", "line")).where(F.trim("line").startswith("{"))
    r = F.from_json("line", RECORD + ", _broken string", {"columnNameOfCorruptRecord": "_broken"})
    parsed = lines.select("session_id", "path", F.col("pos").cast("long").alias("pos"), r.alias("r")).where("r._broken is null")
    return parsed.select("session_id", "pos", "r.type", "r.timestamp", "r.isMeta", "r.message", provider_of(F.col("path")).alias("provider"), "path", F.col("r.sessionId").alias("named_session"))


def iso_ms(c: Column) -> Column:
    """An ISO time in milliseconds; 0 if it is none."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(c)), F.lit(0))


def flat(content: Column) -> Column:
    """A tool result's text: a string as it is, blocks by their texts, blocks of other types as they are written."""
    parts = F.from_json(content, "array<string>")
    one = lambda b: F.when(F.get_json_object(b, "$.type") == "text", F.coalesce(F.get_json_object(b, "$.text"), F.lit(""))).otherwise(b)
    return F.when(content.startswith("["), F.coalesce(F.array_join(F.transform(parts, one), "\n"), content)).otherwise(F.coalesce(content, F.lit("")))


def shown(content: Column) -> Column:
    """A message's text as it is displayed: its texts and its thinking, which is marked as such."""
    text = lambda b: F.when(b["type"] == "text", F.nullif(b["text"], F.lit(""))).when(b["type"] == "thinking", F.concat(F.lit("(thinking) "), F.nullif(b["thinking"], F.lit(""))))
    return F.array_join(F.transform(_blocks(content), text), "\n")


def _blocks(content: Column) -> Column:
    """Content as blocks; a string is one block of text."""
    empty = F.lit(None)
    kinds = ("type", "text", "thinking", "id", "name", "input", "tool_use_id", "content")
    one = F.struct(*[(F.lit("text") if k == "type" else content if k == "text" else empty.cast("string")).alias(k) for k in kinds], empty.cast("boolean").alias("is_error"))
    return F.when(content.startswith("["), F.from_json(content, BLOCKS)).otherwise(F.array(one))


def skipped(records: DataFrame) -> DataFrame:
    """How many records of each type are no conversation: counted, never dropped in silence."""
    return records.where(~F.col("type").isin("user", "assistant")).groupBy("type").agg(F.count("*").alias("n"))


def unmapped(records: DataFrame) -> DataFrame:
    """How many blocks of each type have no event."""
    known = ("text", "thinking", "tool_use", "tool_result")
    rows = _conversation(records).select(F.explode(_blocks(F.col("m.content"))).alias("b"))
    return rows.where(~F.col("b.type").isin(*known)).groupBy(F.col("b.type").alias("type")).agg(F.count("*").alias("n"))


def _parsed(records: DataFrame) -> DataFrame:
    """Records with their message. Of an assistant message that was streamed in several records the last one counts, at the first
    one's place. Records of other types stay for their time alone. All of a session is in one partition."""
    provider = F.col("provider") if "provider" in records.columns else F.lit(SUBSCRIBED)
    talk = F.col("type").isin("user", "assistant")
    rows = records.repartition("session_id").select("session_id", "pos", "type", iso_ms(F.col("timestamp")).alias("ts"), F.coalesce("isMeta", F.lit(False)).alias("meta"), F.when(talk, F.from_json("message", MESSAGE)).alias("m"), provider.alias("provider"))
    key = F.coalesce(F.when(F.col("type") == "assistant", F.col("m.id")), F.concat(F.lit("#"), F.col("pos").cast("string")))
    last = F.max_by(F.struct("type", "ts", "meta", "m", "provider"), "pos")
    return rows.groupBy("session_id", key.alias("key")).agg(F.min("pos").alias("pos"), F.min(F.when(F.col("ts") > 0, F.col("ts"))).alias("since"), F.max("ts").alias("until"), last.alias("r")).select("session_id", "pos", "since", "until", "r.*")


def _conversation(records: DataFrame) -> DataFrame:
    return _parsed(records).where(F.col("type").isin("user", "assistant"))


def _event(kind: str, **fields: Column) -> Column:
    """An event as a struct; what it doesn't carry is null."""
    return F.struct(F.lit(kind).alias("kind"), *[(fields[k] if k in fields else F.lit(None)).cast(t).alias(k) for k, t in FIELDS.items()])


def _usage(name: str) -> Column:
    return F.coalesce(F.col(f"m.usage.{name}"), F.lit(0))


def normalised(records: DataFrame) -> DataFrame:
    """session_id, id (from 1), ts, kind, and FIELDS, of all sessions with an assistant message.

    A session begins with session_created and ends with its task_telemetry. Each record becomes an array of its events, so
    blocks are parsed and exploded once; totals, the start of an ask (the last operator text's time, or else the session's
    first) and the turns since then are windows over the session."""
    session = Window.partitionBy("session_id")
    so_far = session.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    said = F.col("type") == "assistant"
    b = F.when(F.col("type").isin("user", "assistant"), _blocks(F.col("m.content")))
    spoken = F.when(F.col("type") == "user", F.exists("b", lambda x: (x["type"] == "text") & (F.col("plain") | (F.coalesce(x["text"], F.lit("")) != "")))).otherwise(False)
    real = F.when(said & ~F.col("m.model").isin("<synthetic>", "unknown") & (F.col("m.model") != ""), F.col("m.model"))
    rows = _parsed(records).withColumns({"b": b, "plain": ~F.coalesce(F.col("m.content").startswith("["), F.lit(False))}).withColumn("spoken", F.coalesce(spoken, F.lit(False)))
    rows = rows.withColumns({
        "answers": F.count_if(said).over(session), "first_ts": F.min("since").over(session), "last_ts": F.max("until").over(session), "at_start": F.col("pos") == F.min("pos").over(session), "at_end": F.col("pos") == F.max("pos").over(session),
        "main_model": F.coalesce(F.mode(real, True).over(session), F.lit("unknown")), **{f"total_{v}": F.sum(F.when(said, _usage(k)).otherwise(0)).over(session) for k, v in TOKENS.items()},
        "ask_start": F.coalesce(F.last(F.when(F.col("spoken") & (F.col("ts") > 0), F.col("ts")), True).over(so_far), F.min("since").over(session)), "turns": F.count_if(said).over(so_far),
    }).where("answers > 0")
    rows = rows.withColumn("turn_count", F.col("turns") - F.coalesce(F.last(F.when(F.col("spoken"), F.col("turns")), True).over(so_far), F.lit(0)))
    return _numbered(rows.select("session_id", "pos", "ts", "first_ts", "last_ts", F.posexplode(_events_of_record()).alias("at", "e")))


def _events_of_record() -> Column:
    injected = lambda text: F.coalesce(text.rlike(rf"^\s*<({'|'.join(INJECTED)})\b"), F.lit(False))
    stop = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STOPS.items() for x in kv]), F.col("m.stop_reason")), F.lit("end_turn"))
    nothing = F.array().cast("array<struct<kind string, " + ", ".join(f"{k} {t}" for k, t in FIELDS.items()) + ">>")
    text = lambda x: F.coalesce(x["text"], F.lit(""))
    user = F.transform(
        F.filter("b", lambda x: (x["type"] == "tool_result") | ((x["type"] == "text") & (F.col("plain") | (text(x) != "")))),
        lambda x: F.when(x["type"] == "text", _event("user_message", content=text(x), meta=F.when(F.col("meta") | injected(x["text"]), "true"))).otherwise(_event("tool_result", call_id=F.coalesce(x["tool_use_id"], F.lit("")), content=flat(x["content"]), is_error=F.coalesce(x["is_error"], F.lit(False)))),
    )
    known = ("text", "thinking", "tool_use")
    texts = F.filter(F.transform("b", lambda x: F.when(x["type"] == "text", x["text"]).when(~x["type"].isin(*known), F.concat(F.lit("[cc-unmapped-block:"), x["type"], F.lit("]")))), lambda x: x.isNotNull())
    message = _event("assistant_message_event", content=F.array_join(texts, "\n"), stop_reason=stop, model=F.coalesce("m.model", F.lit("unknown")), **{v: _usage(k) for k, v in TOKENS.items()})
    calls = F.transform(F.filter("b", lambda x: x["type"] == "tool_use"), lambda x: _event("tool_call", call_id=F.coalesce(x["id"], F.lit("")), name=F.coalesce(F.nullif(x["name"], F.lit("")), F.lit("unknown")), arguments=F.coalesce(x["input"], F.lit("{}"))))
    took = F.when((F.col("ts") > 0) & F.col("ask_start").isNotNull(), F.greatest(F.lit(0), F.col("ts") - F.col("ask_start")))
    done = F.when(stop != "tool_use", F.array(_event("done", stop_reason=stop, turn_count=F.col("turn_count"), elapsed_ms=took))).otherwise(nothing)
    created = _event("session_created", provider_kind=F.col("provider"), model=F.col("main_model"))
    total = _event(
        "task_telemetry", task_id=F.concat(F.lit("cc-"), F.col("session_id")), provider_kind=F.col("provider"), model=F.col("main_model"), exit_reason=F.lit("done"), started_at_unix_ms=F.col("first_ts"), ended_at_unix_ms=F.coalesce("last_ts", F.lit(0)),
        wall_clock_ms=F.greatest(F.lit(0), F.col("last_ts") - F.col("first_ts")), **{v: F.col(f"total_{v}") for v in TOKENS.values()},
    )
    own = F.when(F.col("type") == "assistant", F.concat(F.array(message), calls, done)).when(F.col("type") == "user", user).otherwise(nothing)
    return F.concat(F.when(F.col("at_start"), F.array(created)).otherwise(nothing), own, F.when(F.col("at_end"), F.array(total)).otherwise(nothing))


def _numbered(events: DataFrame) -> DataFrame:
    """Events with their ids, and tool results with the name of the tool that was called before them under their call's id."""
    called = F.last(F.when(F.col("kind") == "tool_call", F.col("name")), True).over(Window.partitionBy("session_id", "call_id").orderBy("id"))
    ts = F.when(F.col("e.kind") == "session_created", F.coalesce("first_ts", F.lit(0))).when(F.col("e.kind") == "task_telemetry", F.coalesce("last_ts", F.lit(0))).otherwise(F.col("ts"))
    out = events.select("session_id", F.row_number().over(Window.partitionBy("session_id").orderBy("pos", "at")).cast("long").alias("id"), ts.alias("ts"), "e.*")
    out = out.withColumn("call_id", F.when((F.col("kind") == "tool_call") & (F.col("call_id") == ""), F.concat(F.lit("c"), F.col("id").cast("string"))).otherwise(F.col("call_id")))
    return out.withColumn("name", F.when(F.col("kind") == "tool_result", F.coalesce(called, F.lit("unknown"))).otherwise(F.col("name")))
