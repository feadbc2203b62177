"""Summaries and choices that reports open with: default sessions, totals, whole lists by session, sorted queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.dims import READ, WRITE_5M, with_rates
from tracewell.operators.panels import flags
from tracewell.operators.scans import operator_messages
from tracewell.operators.sessions import KEY, session_ref

MU_KEY = ("daemon", "session_id")
RANKS = ("high", "med", "low")


def _first(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows in an order that leaves no ties: a top-n, not a sort of everything."""
    return df.orderBy(*order).limit(n)


def best_trajectory(ev: DataFrame, assemblies: int = 15, compacted: int = 1) -> DataFrame:
    """The daemon to show: of those with enough assemblies and a compaction the one of the widest context, else the busiest."""
    context = F.col("kind") == "context_assembly"
    per = ev.where(F.col("kind").isin("context_assembly", "compaction_assembly")).groupBy("daemon").agg(
        F.count_if(context & F.col("token_count").isNotNull()).alias("points"), F.count_if(context).alias("assemblies"),
        (F.max(F.when(context, F.col("token_count"))) - F.min(F.when(context, F.col("token_count")))).alias("range"), F.count_if(~context).alias("compactions"),
    )
    fit = (F.col("points") >= assemblies) & (F.col("compactions") >= compacted)
    return _first(per.withColumn("fits", fit), 1, F.desc("fits"), F.desc_nulls_last(F.when(fit, F.col("range"))), F.desc("assemblies"), "daemon")


def default_session(ev: DataFrame, least: int = 12, most: int = 60) -> DataFrame:
    """The session to show asks of: the busiest of those with least to most assistant turns, else the busiest of all."""
    per = ev.where("kind = 'assistant_message_event'").groupBy(*MU_KEY).agg(F.count("*").alias("turns"))
    return _first(per.withColumn("fits", F.col("turns").between(least, most)), 1, F.desc("fits"), F.desc("turns"), *MU_KEY)


def latest_models(ev: DataFrame, *key: str) -> DataFrame:
    """Each key's latest model by telemetry."""
    return ev.where("kind = 'task_telemetry' and model is not null").groupBy(*key).agg(F.max_by("model", F.struct("ts", "id")).alias("model"))


def ask_candidates(ev: DataFrame, least: int = 4, most: int = 60, limit: int = 40) -> DataFrame:
    """Sessions to price asks of: their latest model, or else their daemon's; Claude's first, then by cache writes and turns."""
    turns = F.col("kind") == "assistant_message_event"
    per = ev.where(F.col("kind").isin("assistant_message_event", "task_telemetry")).groupBy(*MU_KEY).agg(
        F.count_if(turns).alias("turns"), F.sum(F.coalesce("cache_write_tokens", F.lit(0))).alias("cache_writes"), F.max(F.when(turns, F.col("ts"))).alias("last_ts"),
    ).where(F.col("turns").between(least, most))
    own, daemon = latest_models(ev, *MU_KEY).withColumnRenamed("model", "own"), latest_models(ev, "daemon").withColumnRenamed("model", "of_daemon")
    out = per.join(own, list(MU_KEY), "left").join(daemon, "daemon", "left").select(*MU_KEY, F.coalesce("own", "of_daemon").alias("model"), "turns", "cache_writes", "last_ts")
    claude = F.coalesce(F.col("model").startswith("claude-"), F.lit(False))
    return _first(out, limit, F.desc(claude), F.desc("cache_writes"), F.desc("turns"), *MU_KEY)


def cost_composition(ev: DataFrame) -> DataFrame:
    """What the costliest session paid for: input, output, cache reads, cache writes."""
    kinds = {"input": ("prompt_tokens", "input_rate", 1.0), "output": ("completion_tokens", "output_rate", 1.0), "cache_read": ("cache_read_tokens", "input_rate", READ), "cache_write": ("cache_write_tokens", "input_rate", WRITE_5M)}
    rows = with_rates(ev.where("kind = 'task_telemetry'"))
    units = {n: F.sum(F.round(F.coalesce(F.col(c) * F.col(r) * m / 1e6, F.lit(0.0)) * 1e10).cast("long")) for n, (c, r, m) in kinds.items()}
    per = rows.groupBy(*KEY).agg(*[(u / 1e10).alias(n) for n, u in units.items()], (sum(units.values()) / 1e10).alias("cost"))
    return _first(per, 1, F.desc("cost"), *KEY)


def mark_summary(marks: DataFrame) -> DataFrame:
    """marks(session_ref, created_ms): how many, in how many sessions, on how many days."""
    return marks.agg(F.count("*").alias("marks"), F.countDistinct("session_ref").alias("sessions"), F.countDistinct(F.to_date(F.timestamp_millis("created_ms"))).alias("days"))


def verdict_lists(verdicts: DataFrame) -> DataFrame:
    """All classes that each session was judged by, those that fired first, then by name."""
    row = F.struct((F.col("occurred") != 1).alias("quiet"), "behavior", "severity")
    shown = lambda x: F.concat_ws(" ", F.when(x["quiet"], "-").otherwise("+"), x["behavior"], x["severity"])
    return verdicts.groupBy("session_ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), shown), ";").alias("verdicts"))


def context_summary(ev: DataFrame, drop_abs: int = 20_000, drop_share: float = 0.3) -> DataFrame:
    """Each fleet's first context of a session in whole thousands of tokens: nearest-rank p10, median and p90, over sessions of
    two or more; sessions with compactions, and these. Ranks are told from counts by value, so no task sorts sessions."""
    order = Window.partitionBy(*KEY).orderBy("id")
    rows = ev.where("token_count > 0").select(*KEY, "id", "token_count", F.lag("token_count").over(order).alias("before"))
    fell = F.col("before") - F.col("token_count") >= F.greatest(F.lit(float(drop_abs)), drop_share * F.col("before"))
    per = rows.groupBy(*KEY).agg(F.floor(F.min_by("token_count", "id") / 1000).alias("k"), F.count("*").alias("n"), F.count_if(fell).alias("spots")).where("n >= 2")
    counts = per.groupBy("fleet", "k").agg(F.count("*").alias("n"), F.count_if(F.col("spots") > 0).alias("compacted"), F.sum("spots").alias("spots"))
    up = Window.partitionBy("fleet").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"upto": F.sum("n").over(up), "of": F.sum("n").over(Window.partitionBy("fleet"))})
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("of") - 1, F.floor(F.lit(p) * F.col("of"))), F.col("k")))
    return counts.groupBy("fleet").agg(F.sum("n").alias("sessions"), at(0.1).alias("p10_k"), at(0.5).alias("median_k"), at(0.9).alias("p90_k"), F.sum("compacted").alias("compacted"), F.sum("spots").alias("spots"))


def strata(sample: DataFrame) -> DataFrame:
    """How many sessions of a sample each fleet and band has."""
    return sample.groupBy("fleet", "band").agg(F.count("*").alias("n"))


def topics(ev: DataFrame, length: int = 200) -> DataFrame:
    """Each session's first operator message on one line, cut to a length."""
    line = F.left(F.translate("content", "\n", " "), F.lit(length))
    return operator_messages(ev).where("content is not null").groupBy(*KEY).agg(F.min_by(line, "id").alias("topic"))


def flagged_total(ev: DataFrame, fleet: str = "mu") -> DataFrame:
    """Rows of the whole flagged queue, by reason."""
    return flags(ev.where(F.col("fleet") == fleet)).groupBy("reason").agg(F.count("*").alias("n"))


def ranked_signals(signals: DataFrame, limit: int = 400) -> DataFrame:
    """signals(session_ref, severity, hits, ...): the worst first."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, RANKS)), F.col("severity")), F.lit(0))
    return _first(signals.withColumn("rank", F.when(rank == 0, 9).otherwise(rank - 1).cast("long")), limit, "rank", F.desc("hits"), "session_ref")


def shown_sessions(scan: DataFrame, windows: tuple[str, ...], top: int = 20) -> DataFrame:
    """Sessions with markers, by density and number of these: the first `top`, and all of the given windows. Only the first ones
    are ranked; the rest is a filter."""
    hits = scan.where("hits > 0").withColumn("density", F.col("hits") / F.greatest("n_user", F.lit(1)))
    first = _first(hits, top, F.desc("density"), F.desc("hits"), "session_ref").withColumn("listed", F.lit(True))
    rest = hits.where(F.col("window").isin(*windows)).join(first.select("session_ref"), "session_ref", "left_anti").withColumn("listed", F.lit(False))
    return first.unionByName(rest).select("session_ref", "hits", "n_user", "window", "listed")


def real_sessions(ev: DataFrame, fleet: str = "mu") -> DataFrame:
    """Sessions of a fleet without any record of a test model or provider."""
    mine = ev.where(F.col("fleet") == fleet)
    test = mine.where("lower(model) = 'faux' or lower(provider) in ('faux', 'mock')").select(*KEY).distinct()
    return mine.groupBy(*KEY).agg(F.count("*").alias("events")).join(test, list(KEY), "left_anti")


def sessionized(tasks: DataFrame, session_map: DataFrame) -> DataFrame:
    """Tasks with the session whose list names them; a task that none names stands for itself."""
    of = session_map.select(*MU_KEY, F.explode(F.split("task_ids", ",")).alias("task_id"))
    return tasks.select("task_id", "ts").join(of, "task_id", "left").select("task_id", "ts", *MU_KEY, F.col("session_id").isNotNull().alias("matched"))


def keyed_messages(ev: DataFrame) -> DataFrame:
    """Conversational events counted by the key that a session is shown by: mu's daemon and session, cc's task."""
    task = ev.where("kind = 'task_telemetry' and fleet = 'cc'").groupBy("session_id").agg(F.min("task_id").alias("task"))
    rows = ev.where(F.col("kind").isin("user_message", "assistant_message_event", "tool_call", "tool_result")).groupBy("fleet", *MU_KEY).agg(F.count("*").alias("n"))
    key = F.when(F.col("fleet") == "mu", F.concat_ws("/", "daemon", "session_id")).otherwise(F.col("task"))
    return rows.join(task, "session_id", "left").select("fleet", key.alias("key"), "n").where("key is not null").groupBy("fleet", "key").agg(F.sum("n").alias("events"))


def delegation_totals(workers: DataFrame) -> DataFrame:
    """Workers and the sessions that sent them, by outcome, with their mean time."""
    return workers.groupBy("outcome").agg(F.count("*").alias("workers"), F.countDistinct(*KEY).alias("orchestrators"), F.avg("took").alias("mean_ms"))


def marker_presence(scan: DataFrame, contexts: DataFrame) -> DataFrame:
    """scan(session_ref, n_user, hits), contexts(session_ref, max_context): marker presence of each session beside its context."""
    return scan.join(contexts, "session_ref", "left").select("session_ref", "n_user", "hits", (F.col("hits") > 0).alias("present"), "max_context")


def newest_copies(files: DataFrame) -> DataFrame:
    """files(session, path, mtime): the newest path of each session."""
    return files.groupBy("session").agg(F.max_by("path", F.struct("mtime", "path")).alias("path"), F.max("mtime").alias("mtime"))


def flagged_by_marks(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Sessions (fleet, session, display_id), flagged where a mark names them by display id or by canonical reference: two joins
    by equality, not one by either."""
    names = marks.select("session_ref").distinct()
    by_ref, by_id = names.select(F.col("session_ref").alias("ref"), F.lit(True).alias("_a")), names.select(F.col("session_ref").alias("display_id"), F.lit(True).alias("_b"))
    out = rows.withColumn("ref", session_ref(F.col("fleet"), F.col("session"))).join(by_ref, "ref", "left").join(by_id, "display_id", "left")
    return out.select("fleet", "session", F.coalesce("_a", "_b", F.lit(False)).alias("flagged"))


def restricted(ev: DataFrame, candidates: DataFrame, *key: str) -> DataFrame:
    """Events of the candidates alone. Left to the planner, which sends candidates to all tasks only where they are few."""
    return ev.join(candidates.select(*key), list(key), "left_semi")
