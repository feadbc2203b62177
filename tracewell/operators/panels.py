"""Panels: small reports over the event relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.dims import READ, WRITE_1H, WRITE_5M, list_price, to_grid, with_rates
from tracewell.operators.costs import cost_sum
from tracewell.functions.text import tool_family
from tracewell.operators.quantiles import by_metric, counted, quantiles, stacked
from tracewell.operators.sessions import KEY

#: How a task may end badly, recall sources' names, and what compaction decides.
BAD_STOPS = ("degraded_eof", "aborted", "error", "max_tokens", "iteration_cap")
RECALL_SOURCES = {"project_file": "ProjectFile", "filesystem": "ProjectFile", "memory": "Memory", "bootloader": "Bootloader"}
ACTIONS = ("kept", "dropped", "summarized", "failed")
#: Why a session is flagged: confidence and order.
CONFIDENCE = {"deg": "Probable 0.62", "err": "Probable 0.70", "callout": "Definite 0.88", "tomb": "Inferred 0.41"}
SEVERITY = {"deg": 0, "err": 1, "callout": 2, "tomb": 3}


def day(ts: str = "ts") -> Column:
    return F.to_date(F.timestamp_millis(ts))


def share(part: Column) -> Column:
    return F.avg(part.cast("double"))


def histogram(ev: DataFrame, *keys: str) -> DataFrame:
    return ev.groupBy(*keys).agg(F.count("*").alias("n"))


def corpus_totals(ev: DataFrame) -> DataFrame:
    return ev.agg(F.count("*").alias("events"), F.countDistinct("daemon").alias("daemons"), F.countDistinct("fleet", "session").alias("sessions"))


def tool_mix(ev: DataFrame, limit: int = 12) -> DataFrame:
    calls = ev.where("kind = 'tool_call'").select("fleet", tool_family(F.col("tool_name")).alias("tool"))
    out = calls.groupBy("tool").agg(F.count("*").alias("n"), *[F.count_if(F.col("fleet") == f).alias(f) for f in ("mu", "cc")])
    return out.orderBy(F.desc("n"), "tool").limit(limit)


def recall(ev: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in RECALL_SOURCES.items() for x in kv])
    items = ev.where("kind = 'recall_provenance'").select(F.coalesce(F.element_at(names, F.col("recall_source")), F.col("recall_source")).alias("source"), "recall_tokens")
    return items.groupBy("source").agg(F.count("*").alias("items"), F.sum("recall_tokens").alias("tokens"))


def compaction(ev: DataFrame) -> DataFrame:
    """Each fleet's decisions by action, events and tokens; fleets without a compaction have a row of zeros."""
    made = F.col("kind") == "compaction_assembly"
    return ev.groupBy("fleet").agg(
        *[F.count_if(made & (F.col("action") == a)).alias(a) for a in ACTIONS], F.count_if(made).alias("events"),
        *[F.sum(F.when(made, F.col(c)).otherwise(0)).alias(c) for c in ("tokens_before", "tokens_after")],
    )


def stop_reasons(ev: DataFrame) -> DataFrame:
    return ev.where("kind = 'done'").groupBy("stop_reason").agg(F.count("*").alias("n"))


def degradation_by_day(ev: DataFrame) -> DataFrame:
    return ev.where("kind = 'done'").groupBy(day().alias("day")).agg(F.count("*").alias("n"), share(F.col("stop_reason").isin(*BAD_STOPS)).alias("rate"))


def degradation_rate(ev: DataFrame) -> DataFrame:
    rate = F.coalesce(F.round(100 * share(F.col("stop_reason").isin(*BAD_STOPS)), 1), F.lit(0.0))
    return ev.where("kind = 'done'").agg(F.count("*").alias("n"), rate.alias("percent"))


def ask_gaps(ev: DataFrame) -> DataFrame:
    """Minutes between a session's model calls."""
    order = Window.partitionBy("fleet", "daemon", "session_id").orderBy("ts", "id")
    return ev.where("kind = 'assistant_message_event'").select("fleet", "daemon", "session_id", "id", ((F.col("ts") - F.lag("ts").over(order)) / 60000.0).alias("gap"))


def _blended(gap: Column, ttl: float, write: float, rate: float = 5.0, prefix: int = 60_000, asks: int = 40) -> Column:
    """What a session's stable prefix costs if it is read again at each ask, or written again when the cache has lapsed."""
    lapsed = F.when(gap > 0, F.exp(-ttl / gap)).otherwise(0.0)
    unit = prefix * rate / 1e6
    return asks * ((1 - lapsed) * unit * READ + lapsed * unit * write)


def saving(gap: Column) -> Column:
    """Percent saved by keeping the cache for an hour instead of five minutes, at a gap."""
    five, hour = _blended(gap, 5, WRITE_5M), _blended(gap, 60, WRITE_1H)
    return F.when(gap <= 0, 0.0).otherwise(F.round((five - hour) / five * 100, 1))


def cache_econ(ev: DataFrame) -> DataFrame:
    inside = F.col("gap").between(0, 120)
    rows = ask_gaps(ev)
    middle = quantiles(counted(rows.where(inside), [], "gap"), [], [0.5, 0.9]).agg(*[F.round(F.coalesce(F.max(F.col("q")[i]), F.lit(0.0)), 2).alias(n) for i, n in enumerate(("median_gap_min", "p90_gap_min"))])
    gaps = rows.agg(
        F.count_if(inside).alias("gap_count"), F.count_if((F.col("gap") > 5) & (F.col("gap") <= 60)).alias("expired_5m_count"),
        F.count_if(F.col("gap").between(4, 6)).alias("near_miss_4_6m_count"), F.count_if(F.col("gap") > 60).alias("over_60m_count"),
    )
    volume = ev.where("kind = 'task_telemetry'").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("cache_write_5m_tokens", "w5_tokens"), ("cache_write_1h_tokens", "w1_tokens"), ("cache_read_tokens", "read_tokens"))])
    one = F.lit(1).alias("one")
    out = middle.select("*", one).join(gaps.select("*", one), "one").join(volume.select("*", one), "one").drop("one")  # one row each
    return out.withColumns({"save_pct": saving(F.col("median_gap_min")), "save_pct_p90": saving(F.col("p90_gap_min"))})


def per_ask(ev: DataFrame, asks: int = 30) -> DataFrame:
    """The first asks of each session with telemetry: gap since the one before, cost, and what writing the cache again costs."""
    order = Window.partitionBy("fleet", "daemon", "session_id").orderBy("ts", "id")
    rows = ev.where("kind = 'task_telemetry'").withColumns({"n": F.row_number().over(order), "gap_min": F.round((F.col("ts") - F.lag("ts").over(order)) / 60000.0, 2)}).where(F.col("n") <= asks)
    out = with_rates(rows)
    rewrite = F.col("cache_read_tokens") * F.col("input_rate") * WRITE_5M / 1e6
    return out.select(
        "fleet", "daemon", "session_id", F.col("n").cast("long").alias("ask"), "model", "gap_min", to_grid(F.coalesce(list_price(), F.lit(0.0))).alias("cost"),
        to_grid(F.coalesce(rewrite, F.lit(0.0))).alias("rewrite_5m"), F.coalesce(F.col("gap_min") > 5, F.lit(False)).alias("expired_5m"),
    )


def per_ask_sessions(ev: DataFrame, sessions: int = 12) -> DataFrame:
    """The costliest sessions by the sum of their asks' costs."""
    asks = per_ask(ev)
    out = asks.groupBy("fleet", "daemon", "session_id").agg(F.count("*").alias("asks"), cost_sum(), F.count_if("expired_5m").alias("expired"))
    return out.where("cost > 0").orderBy(F.desc("cost"), "fleet", "daemon", "session_id").limit(sessions)


def flags(ev: DataFrame) -> DataFrame:
    """(daemon, session_id, model, reason, why): the signs that a session wants a look, one row for each reason, and its latest
    model. All of it is one aggregate over one scan."""
    kind = F.col("kind")
    bad = (kind == "done") & F.col("stop_reason").isin("degraded_eof", "max_tokens", "iteration_cap", "aborted")
    failed = (kind == "task_telemetry") & F.col("exit_reason").isin("error", "cancelled")
    stamped = (kind == "task_telemetry") & F.col("model").isNotNull()
    deg = F.when(bad, F.format_string("stop_reason=%s mid-task", "stop_reason")).when(kind == "autonomous_terminated", F.concat(F.lit("autonomous_terminated: "), F.coalesce("content", F.lit("?"))))
    said = F.when(kind == "callout", F.concat(F.lit("self-flag: "), F.coalesce("content", F.lit("(callout)"))))
    per = ev.where(bad | failed | stamped | kind.isin("autonomous_terminated", "callout") | ((kind == "tool_result") & F.col("is_error"))).groupBy("daemon", "session_id").agg(
        F.min(deg).alias("deg"), F.min(F.when(failed, F.concat(F.lit("exit_reason="), "exit_reason"))).alias("failed"), F.count_if(kind == "tool_result").alias("errors"), F.min(said).alias("callout"), F.max_by(F.when(stamped, F.col("model")), F.when(stamped, F.struct("ts", "id"))).alias("model"),
    )
    err = F.least("failed", F.when(F.col("errors") >= 5, F.concat(F.col("errors").cast("string"), F.lit(" tool_result.is_error in session"))))
    each = F.array(*[F.struct(F.lit(name).alias("reason"), why.alias("why")) for name, why in (("deg", F.col("deg")), ("err", err), ("callout", F.col("callout")))])
    return per.select("daemon", "session_id", "model", F.explode(F.filter(each, lambda x: x["why"].isNotNull())).alias("x")).select("daemon", "session_id", "model", "x.reason", "x.why")


def flagged_queue(ev: DataFrame, fleet: str = "mu", limit: int = 12) -> DataFrame:
    """One row for each session and reason, the reasons taking turns in order of severity."""
    found = flags(ev.where(F.col("fleet") == fleet))
    confidence = F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), F.col("reason"))
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col("reason")).cast("long")
    turn = F.row_number().over(Window.partitionBy("reason").orderBy("daemon", "session_id")).cast("long")
    return found.select("daemon", "session_id", "reason", "why", "model", confidence.alias("confidence"), rank.alias("severity"), turn.alias("turn")).where(F.col("turn") <= limit).orderBy("turn", "severity").limit(limit)


def context_trajectory(ev: DataFrame, cap: int = 80) -> DataFrame:
    """Each session's context depth in thousands of tokens, at no more than cap evenly spread points, with drops marked."""
    order = Window.partitionBy(*KEY).orderBy("id")
    whole = Window.partitionBy(*KEY)
    rows = ev.where("token_count is not null").select(*KEY, "id", (F.row_number().over(order) - 1).alias("i"), F.count("*").over(whole).alias("n"), F.round(F.col("token_count") / 1000.0).alias("k_tokens"))
    # Point p of cap is row floor(p * n / cap): a row is a point if a multiple of n / cap falls on it.
    point = F.ceil(F.col("i") * cap / F.col("n"))
    rows = rows.where((F.col("n") <= cap) | ((F.floor(point * F.col("n") / cap) == F.col("i")) & (point < cap)))
    return rows.select(*KEY, "id", "k_tokens", F.coalesce(F.col("k_tokens") < F.lag("k_tokens").over(order), F.lit(False)).alias("drop"))


def context_disparity(ev: DataFrame) -> DataFrame:
    """Each fleet's first and largest context: medians, nearest-rank p90, maximum and median growth, over sessions of two or more."""
    per = ev.where("token_count > 0").groupBy(*KEY).agg(F.min_by("token_count", "id").alias("first"), F.max("token_count").alias("most"), F.count("*").alias("n")).where("n >= 2")
    counts = counted(stacked(per, ["fleet"], {"first": F.col("first"), "most": F.col("most"), "growth": F.col("most") / F.col("first")}), ["fleet", "metric"])
    by = ["fleet", "metric"]
    middle = by_metric(quantiles(counts, by, [0.5]), ["fleet"], {"first": ["first_median"], "most": ["max_median"], "growth": ["growth_median"]})
    p90 = by_metric(quantiles(counts.where("metric = 'most'"), by, [0.9], nearest=True), ["fleet"], {"most": ["max_p90"]})
    whole = per.groupBy("fleet").agg(F.count("*").alias("sessions"), F.max("most").alias("max_max"))
    return whole.join(middle, "fleet").join(p90, "fleet").select("fleet", "sessions", "first_median", "max_median", F.col("max_p90").cast("long").alias("max_p90"), "max_max", F.round("growth_median", 6).alias("growth_median"))


def compactions(ev: DataFrame, drop_abs: int = 20_000, drop_share: float = 0.3) -> DataFrame:
    """Sessions whose context fell by max(drop_abs, drop_share of it) from one call to the next, and how often."""
    order = Window.partitionBy(*KEY).orderBy("id")
    rows = ev.where("token_count is not null").withColumn("before", F.lag("token_count").over(order))
    fell = F.col("before") - F.col("token_count") >= F.greatest(F.lit(float(drop_abs)), drop_share * F.col("before"))
    return rows.groupBy(*KEY).agg(F.count_if(fell).alias("spots")).where("spots > 0")


def delegations(ev: DataFrame, now_ms: int, stale_ms: int = 6 * 3_600_000) -> DataFrame:
    """Workers: the i-th spawned of a session goes with the i-th end in it; one without an end is running, or stale."""
    order = Window.partitionBy(*KEY).orderBy("id")
    spawned = ev.where("kind = 'worker_spawned'").select(*KEY, "id", "ts", "model", F.row_number().over(order).alias("rn"))
    ends = ev.where(F.col("kind").isin("worker_exited", "worker_failed", "worker_timeout")).select(*KEY, F.col("kind").alias("end"), F.col("elapsed_ms").alias("took"), F.row_number().over(order).alias("rn"))
    outcome = F.when(F.col("end").isNotNull(), F.regexp_replace("end", "worker_", "")).when(now_ms - F.col("ts") > stale_ms, "unknown-stale").otherwise("running")
    return spawned.join(ends, [*KEY, "rn"], "left").select(*KEY, F.col("rn").cast("long").alias("n"), "ts", "model", outcome.alias("outcome"), "took")


def mailbox(ev: DataFrame) -> DataFrame:
    posted = F.col("kind") == "mailbox_message_posted"
    return ev.where("kind like 'mailbox%'").groupBy("message_kind").agg(F.count_if(posted).alias("posted"), F.count_if(~posted).alias("consumed"))
