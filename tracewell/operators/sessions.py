"""Sessions: their features, prices and map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.dims import cost_kind, is_noise, priced

KEY = ("fleet", "session")
GAP_MS = 300_000


def session_ref(fleet: Column, session: Column) -> Column:
    return F.concat_ws(":", fleet, session)


def when_kind(kind: str, value: Column) -> Column:
    return F.when(F.col("kind") == kind, value)


def total(kind: str, column: str) -> Column:
    return F.sum(F.coalesce(when_kind(kind, F.col(column)), F.lit(0))).cast("long")


def session_features(ev: DataFrame) -> DataFrame:
    """One row for each session with telemetry: token sums, latency, tools, gaps, context depth, price and time of week.

    The gap needs the events of a session in order, the rest are aggregates over the same key: one exchange serves both."""
    order = Window.partitionBy(*KEY).orderBy("id")
    gap = (F.col("ts") - F.lag("ts").over(order)) > GAP_MS
    tel = F.col("kind") == "task_telemetry"
    done, context = when_kind("done", F.col("elapsed_ms")), F.when(F.col("kind") == F.when(F.col("fleet") == "mu", "context_assembly").otherwise("assistant_message_event"), F.col("token_count"))
    per = (
        ev.select(*KEY, "id", "ts", "kind", "prompt_tokens", "completion_tokens", "cache_read_tokens", "cache_write_tokens", "elapsed_ms", "token_count", "model", "provider").withColumn("gap", gap)
        .groupBy(*KEY).agg(
            *[total("task_telemetry", c).alias(c) for c in ("prompt_tokens", "completion_tokens", "cache_read_tokens", "cache_write_tokens")],
            F.count_if(tel).alias("n_tasks"), F.min(F.when(tel, F.col("ts"))).alias("started_ms"),
            F.mode(F.when(tel, F.col("model")), True).alias("model"), F.mode(F.when(tel, F.col("provider")), True).alias("provider"),
            F.percentile(done, F.array(F.lit(0.5), F.lit(0.95))).alias("p"), F.count_if(F.col("kind") == "done").alias("n_asks"),
            F.count_if(F.col("kind") == "tool_call").alias("n_tools"), F.count_if("gap").alias("n_gaps"),
            F.max(context).alias("max_context"), F.min_by(context, F.when(context.isNotNull(), F.col("id"))).alias("first_context"),
        ).where("n_tasks > 0")
    )
    out = priced(per)
    at = F.timestamp_millis("started_ms")
    return out.where(~is_noise(F.col("model"))).select(
        session_ref(F.col("fleet"), F.col("session")).alias("session_ref"), "fleet", "session", "n_tasks", "prompt_tokens", "completion_tokens", "cache_read_tokens", "cache_write_tokens",
        "model", "provider", "started_ms", F.col("p")[0].alias("latency_p50"), F.col("p")[1].alias("latency_p95"), "n_asks", "n_tools", "n_gaps", "max_context", "first_context",
        F.hour(at).cast("long").alias("hour"), F.weekday(at).cast("long").alias("weekday"), F.round("cost", 4).alias("cost"), cost_kind(F.col("provider"), F.col("model")).alias("cost_kind"),
    )


def feature_coverage(features: DataFrame) -> DataFrame:
    """Sessions, priced sessions and cost of each fleet."""
    return features.groupBy("fleet").agg(F.count("*").alias("sessions"), F.count_if(F.col("cost") > 0).alias("priced"), (F.sum(F.round(F.col("cost") * 1e4).cast("long")) / 1e4).alias("cost"))


def session_map(ev: DataFrame, fleet: str = "mu") -> DataFrame:
    """One row for each (daemon, session_id) with telemetry: start, latest model, distinct tasks, tool calls."""
    mine = ev.where((F.col("fleet") == fleet) & F.col("kind").isin("task_telemetry", "tool_call"))
    tel = F.col("kind") == "task_telemetry"
    known = tel & F.col("model").isNotNull()
    return (
        mine.groupBy("daemon", "session_id").agg(
            F.min(F.when(tel, F.col("ts"))).alias("started_ms"), F.max_by("model", F.when(known, F.struct("ts", "id"))).alias("model"),
            F.array_join(F.array_sort(F.collect_set(F.when(tel, F.col("task_id")))), ",").alias("task_ids"), F.count_if(~tel).alias("tool_calls"),
        ).where("started_ms is not null")
    )


def first_events(ev: DataFrame) -> DataFrame:
    """The first event's kind and time of each session."""
    return ev.groupBy(*KEY).agg(F.min_by(F.struct("ts", "kind"), F.struct("ts", "id")).alias("first")).select(*KEY, F.col("first.ts").alias("first_ms"), F.col("first.kind").alias("first_kind"))


def tasks(ev: DataFrame) -> DataFrame:
    """The task table: one row for each task, the latest telemetry of it, with price, cost kind and its session's tool calls."""
    tel = ev.where("kind = 'task_telemetry'")
    last = Window.partitionBy("task_id").orderBy(F.desc("ts"), F.desc("id"))
    tel = tel.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
    tools = ev.where("kind = 'tool_call'").groupBy(*KEY).agg(F.count("*").alias("tool_calls"))
    out = priced(tel.join(tools, list(KEY), "left"))
    return out.select(
        "task_id", *KEY, "model", "provider", "exit_reason", F.coalesce("outcome_class", F.lit("unclassified")).alias("outcome_class"), F.coalesce("tool_calls", F.lit(0)).alias("tool_calls"),
        "prompt_tokens", "completion_tokens", "cache_read_tokens", "cache_write_tokens", "ts", F.col("rate_key").isNotNull().alias("is_priced"), "cost", cost_kind(F.col("provider"), F.col("model")).alias("cost_kind"),
        F.to_date(F.timestamp_millis("ts")).alias("day"),
    )
