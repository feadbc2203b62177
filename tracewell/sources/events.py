"""Event logs: append-only JSON lines with a fixed envelope and a free payload."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The envelope. The payload stays text, as its shape depends on its kind.
ENVELOPE = "id long, session_id string, timestamp_unix_ms long, actor string, payload string"
EV = "id long, session_id string, ts long, daemon string, session string, kind string, payload string, fleet string"

#: Payload fields that operators read, all nullable.
PAYLOAD_FIELDS = {
    "model": "string", "provider_kind": "string", "task_id": "string", "exit_reason": "string", "outcome_class": "string", "stop_reason": "string",
    "content": "string", "meta": "string", "name": "string", "call_id": "string", "arguments": "string", "is_error": "boolean", "state": "string",
    "title": "string", "reason": "string", "pot_name": "string", "message_kind": "string", "prompt_summary": "string", "rating": "string", "note": "string",
    "elapsed_ms": "bigint", "turn_count": "bigint", "token_count_estimate": "bigint", "tokens_before": "bigint", "tokens_after": "bigint", "exit_code": "bigint",
    "started_at_unix_ms": "bigint", "ended_at_unix_ms": "bigint", "prompt_tokens": "bigint", "completion_tokens": "bigint", "cache_read_tokens": "bigint",
    "cache_write_tokens": "bigint", "cache_write_5m_tokens": "bigint", "cache_write_1h_tokens": "bigint",
}


def empty_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EV)


def read_events(spark: SparkSession, paths: list[str] | str, fleet: str) -> DataFrame:
    """One fleet's logs. Malformed lines are skipped; a missing source is an empty relation of the same type.

    A daemon is the folder that holds a session's file; mu session ids repeat across daemons, so its session key has both."""
    try:
        raw = spark.read.schema(ENVELOPE).option("mode", "DROPMALFORMED").json(paths)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return empty_events(spark)
        raise
    return shaped(raw, fleet)


def shaped(raw: DataFrame, fleet: str) -> DataFrame:
    """Rows of log files as events, in a stream or not."""
    daemon = F.regexp_extract("_metadata.file_path", r".*/([^/]+)/[^/]+$", 1)
    out = raw.withColumn("daemon", daemon).withColumn("fleet", F.lit(fleet))
    session = F.concat_ws(":", "daemon", "session_id") if fleet == "mu" else F.col("session_id")
    return out.select("id", "session_id", F.col("timestamp_unix_ms").alias("ts"), "daemon", session.alias("session"), F.get_json_object("payload", "$.kind").alias("kind"), "payload", "fleet")


def connect(spark: SparkSession, sources: dict[str, list[str] | str]) -> DataFrame:
    """All fleets' events in one relation. sources: fleet -> paths."""
    parts = [read_events(spark, paths, fleet) for fleet, paths in sources.items()]
    return reduce(DataFrame.unionByName, parts) if parts else empty_events(spark)


def typed(ev: DataFrame) -> DataFrame:
    """Events with their payload fields as columns: each payload is parsed once, here."""
    schema = ", ".join(f"{k} {v}" for k, v in PAYLOAD_FIELDS.items())
    p = ev.withColumn("p", F.from_json("payload", schema))
    return p.select("id", "fleet", "daemon", "session_id", "session", "ts", "kind", "payload", "p.*")


def write_events(ev: DataFrame, path: str) -> None:
    """The silver table, laid out by fleet and day."""
    day = F.to_date(F.timestamp_millis("ts"))
    ev.withColumn("event_date", day).write.partitionBy("fleet", "event_date").mode("overwrite").parquet(path)


def write_logs(ev: DataFrame, path: str) -> None:
    """Events as logs of lines, a folder for each daemon."""
    payload = F.to_json(F.struct("kind", *[c for c in ev.columns if c in PAYLOAD_FIELDS]))
    line = F.to_json(F.struct("id", "session_id", F.col("ts").alias("timestamp_unix_ms"), F.lit("agent").alias("actor"), payload.alias("payload")))
    ev.select(F.col("daemon").alias("d"), line.alias("value")).repartition("d").write.partitionBy("d").mode("overwrite").text(path)


def write_tasks(tasks: DataFrame, path: str) -> None:
    """The sink of the task table, by fleet."""
    tasks.write.partitionBy("fleet").mode("overwrite").parquet(path)


def read_tasks(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """Tasks of several sinks (label -> path); a sink that isn't there has none."""
    found = spark.createDataFrame([], f"{schema}, fleet string")
    for label, path in paths.items():
        try:
            found = found.unionByName(spark.read.schema(schema).parquet(path).withColumn("fleet", F.lit(label)))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return found
