"""Receipts: what each session did in a window of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import tool_family
from tracewell.operators.sessions import KEY


def receipts(ev: DataFrame, since_ms: int, until_ms: int) -> DataFrame:
    """Sessions active in [since, until): first and last event, turns and tool calls in it, and their whole lives' last model
    and tokens. Sessions are restricted before anything is aggregated."""
    inside = (F.col("ts") >= since_ms) & (F.col("ts") < until_ms)
    active = ev.where(inside).select(*KEY).distinct()
    rows = ev.join(active, list(KEY), "left_semi")
    known = (F.col("kind") == "task_telemetry") & F.col("model").isNotNull()
    return rows.groupBy(*KEY).agg(
        F.min(F.when(inside, F.col("ts"))).alias("first_ms"), F.max(F.when(inside, F.col("ts"))).alias("last_ms"), F.count_if(inside & (F.col("kind") == "user_message")).alias("turns"),
        F.count_if(inside & (F.col("kind") == "tool_call")).alias("tool_calls"), F.max(F.when(known, F.col("model"))).alias("model"), F.max("completion_tokens").alias("max_tokens"),
    )


def tool_breakdown(ev: DataFrame) -> DataFrame:
    """Each session's tools and their counts, the most used first, as text."""
    n = ev.where("kind = 'tool_call'").groupBy(*KEY, tool_family(F.col("tool_name")).alias("tool")).agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "tool")))
    return n.groupBy(*KEY).agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["tool"], F.lit("="), (-x["m"]).cast("string"))), ",").alias("tools"))


def totals(receipts: DataFrame) -> DataFrame:
    """Of each fleet, and of all."""
    return receipts.rollup("fleet").agg(F.count("*").alias("sessions"), F.sum("turns").alias("turns"), F.sum("tool_calls").alias("tool_calls"))
