"""Timings: model calls by invocation and by turn, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.dims import model_family
from tracewell.operators.quantiles import by_metric, counted, quantiles, stacked
from tracewell.operators.sessions import KEY

MOST_MS = 30 * 60_000


def with_models(calls: DataFrame, ev: DataFrame) -> DataFrame:
    """Calls with the family of their session's model, the one that is most frequent in its telemetry."""
    models = ev.where("kind = 'task_telemetry'").groupBy(*KEY).agg(F.mode("model", True).alias("session_model"))
    return calls.join(models, list(KEY), "left").withColumn("model", model_family(F.col("session_model"))).drop("session_model")


def invocations(ev: DataFrame, fleet: str = "mu") -> DataFrame:
    """One row for each model call. A call begins with each start event (awaiting_first_token for mu; a message or tool result
    for cc) and is closed by the first assistant message after it; a start that another start follows is dropped."""
    start = (F.col("kind") == "provider_status_update") & (F.col("state") == "awaiting_first_token") if fleet == "mu" else F.col("kind").isin("user_message", "tool_result")
    said = F.col("kind") == "assistant_message_event"
    streaming = F.col("state") == "streaming"
    rows = ev.where((F.col("fleet") == fleet) & (start | said | streaming)).select(*KEY, "id", "ts", start.alias("start"), said.alias("said"), F.coalesce(streaming, F.lit(False)).alias("streaming"), "output_tokens")
    order = Window.partitionBy(*KEY).orderBy("id")
    rows = rows.withColumn("call", F.count_if("start").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("call > 0")
    rows = rows.withColumn("answers", F.count_if("said").over(Window.partitionBy(*KEY, "call").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))).where("answers = 0")
    out = rows.groupBy(*KEY, "call").agg(
        F.min(F.when(F.col("start"), F.col("ts"))).alias("start_ms"), F.max(F.when(F.col("said"), F.col("ts"))).alias("end_ms"), F.max(F.when(F.col("said"), F.col("output_tokens"))).alias("tokens"),
        F.max(F.when(F.col("streaming"), F.col("ts"))).alias("stream_ms"),
    ).where("end_ms is not null")
    ttft = F.col("stream_ms") - F.col("start_ms") if fleet == "mu" else F.lit(None).cast("long")
    return out.select(*KEY, "call", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), ttft.alias("ttft_ms"), "tokens", F.lit(1).cast("long").alias("invocations"))


def turns(ev: DataFrame) -> DataFrame:
    """One row for each operator message that was answered: until the next message or `done`, whichever is first."""
    keep = F.col("kind").isin("user_message", "done", "assistant_message_event")
    order = Window.partitionBy(*KEY).orderBy("id")
    user, said = F.col("kind") == "user_message", F.col("kind") == "assistant_message_event"
    rows = ev.where(keep).withColumn("turn", F.count_if(user).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("turn > 0")
    rows = rows.withColumn("over", F.count_if(F.col("kind") == "done").over(Window.partitionBy(*KEY, "turn").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))).where("over = 0")
    out = rows.groupBy(*KEY, "turn").agg(
        F.min(F.when(user, F.col("ts"))).alias("start_ms"), F.max(F.when(~user, F.col("ts"))).alias("end_ms"), F.count_if(said).alias("invocations"), F.sum(F.when(said, F.col("output_tokens"))).alias("tokens"),
    ).where("invocations > 0")
    return out.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))


def within(calls: DataFrame, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """Calls that overlap a window and are not impossibly long."""
    ok = F.col("duration_ms").between(0, MOST_MS)
    if since_ms is not None:
        ok &= F.col("end_ms") >= since_ms
    if until_ms is not None:
        ok &= F.col("start_ms") <= until_ms
    return calls.where(ok)


def workload(calls: DataFrame, **bounds: tuple[float | None, float | None]) -> DataFrame:
    """Calls within (least, most) bounds of the named columns; a bound of None is open."""
    for column, (least, most) in bounds.items():
        if least is not None:
            calls = calls.where(F.col(column) >= least)
        if most is not None:
            calls = calls.where(F.col(column) <= most)
    return calls


def throughput() -> Column:
    """Tokens a second of what was generated, where there were any and it took more than a millisecond."""
    took = F.col("duration_ms") - F.coalesce("ttft_ms", F.lit(0))
    return F.when((took > 1) & (F.col("tokens") > 0), F.col("tokens") * 1000.0 / took)


#: What calls are grouped by, and the percentiles that are told of them.
GRAINS = {"fleet": ("fleet",), "fleet_model": ("fleet", "model"), "day": ("day",), "fleet_day": ("fleet", "day")}
PERCENTILES = (50, 75, 90, 99)


def _grains(df: DataFrame, rest: list[str]) -> DataFrame:
    """Rows by (fleet, model, day) once for each grain, with nulls for what it doesn't tell apart."""
    of = lambda keys: [(F.col(c) if c in keys else F.lit(None).cast("date" if c == "day" else "string")).alias(c) for c in ("fleet", "model", "day")]
    each = F.array(*[F.struct(F.lit(name).alias("grain"), *of(keys)) for name, keys in GRAINS.items()])
    return df.select(F.explode(each).alias("x"), *rest).select("x.*", *rest)


def timing_stats(calls: DataFrame) -> DataFrame:
    """Calls by fleet, fleet and model, day, and fleet and day: how many, tokens, invocations, time, and percentiles of duration,
    time to the first token and throughput. calls may have a model. The finest grain is summed first; the others add it up."""
    model = F.col("model") if "model" in calls.columns else F.lit(None).cast("string")
    calls = calls.withColumns({"model": model, "day": F.to_date(F.timestamp_millis("start_ms")), "speed": throughput(), "ttft": F.col("ttft_ms") if "ttft_ms" in calls.columns else F.lit(None).cast("long")})
    finest, by = ["fleet", "model", "day"], ["grain", "fleet", "model", "day"]
    sums = calls.groupBy(*finest).agg(
        F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("invocations").alias("invocations"), F.max("invocations").alias("invocations_max"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"),
    )
    whole = _grains(sums, ["calls", "tokens", "invocations", "invocations_max", "first_ms", "last_ms"]).groupBy(*by).agg(
        F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), (F.sum("invocations") / F.sum("calls")).alias("invocations_mean"), F.max("invocations_max").alias("invocations_max"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"),
    )
    metrics = {"duration": F.col("duration_ms"), "ttft": F.col("ttft"), "speed": F.col("speed")}
    counts = counted(stacked(calls, finest, metrics), [*finest, "metric"])
    counts = _grains(counts, ["metric", "v", "n"]).groupBy(*by, "metric", "v").agg(F.sum("n").alias("n"))
    names = {m: [f"{m}_p{p}" for p in PERCENTILES] for m in metrics}
    q = by_metric(quantiles(counts, [*by, "metric"], [p / 100 for p in PERCENTILES]), by, names)
    same = whole.withColumn("_k", F.struct(*by)).join(q.select(F.struct(*by).alias("_k"), *[c for ns in names.values() for c in ns]), "_k", "left").drop("_k")
    return same.withColumns({c: F.round(c, 6) for ns in names.values() for c in ns})


def by_family(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy(model_family(F.col("model")).alias("family")).agg(F.count("*").alias("tasks"), F.sum("completion_tokens").alias("tokens"))
