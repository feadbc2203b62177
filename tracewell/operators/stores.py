"""Keyed stores kept as tables: marks, verdicts, findings, and which sources have changed.

A store is read, joined with what is new, and the latest row of each key stays; the caller writes the result in place of the
partitions that it came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The classes that a session is judged by.
BEHAVIORS = 5


def latest(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row of each key: the first in order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(store: DataFrame, new: DataFrame, key: list[str], *ties: str) -> DataFrame:
    """The store with new rows in place of old ones of the same key; of several new rows the one that is last by `ties`."""
    both = store.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, key, F.desc("_new"), *[F.desc_nulls_last(t) for t in ties]).drop("_new")


def rating(value: Column) -> Column:
    """A rating from 1 to 5; what is no number is a 3."""
    number = value.cast("string").try_cast("double")
    return F.when(number.isNull() | F.isnan(number), 3).otherwise(F.least(F.greatest(number.cast("int"), F.lit(1)), F.lit(5)))


def mark_ref(ref: Column, session_id: Column, daemon: Column) -> Column:
    """A mark's session: given outright, or mu's daemon and session, or cc's session."""
    return F.coalesce(ref, F.when(daemon.isNotNull() & session_id.isNotNull(), F.concat(F.lit("mu:"), daemon, F.lit(":"), session_id)), F.concat(F.lit("cc:"), session_id))


def latest_marks(event_marks: DataFrame, store: DataFrame) -> DataFrame:
    """The latest mark of each session: session_ref, rating, note, created_ms; at equal times the store's."""
    both = event_marks.withColumn("_source", F.lit(0)).unionByName(store.withColumn("_source", F.lit(1)))
    return latest(both.where("session_ref is not null"), ["session_ref"], F.desc("created_ms"), F.desc("_source"), F.desc("rating"), F.asc_nulls_last("note")).drop("_source")


def changed(current: DataFrame, ledger: DataFrame) -> DataFrame:
    """Sources (path, mtime) that the ledger (path, mtime) lacks or knows by an older time, the newest first."""
    seen = ledger.select("path", F.col("mtime").alias("_seen"))
    return current.join(seen, "path", "left").where("_seen is null or mtime > _seen").drop("_seen").orderBy(F.desc("mtime"), "path")


def vanished(current: DataFrame, ledger: DataFrame) -> DataFrame:
    return ledger.join(current.select("path"), "path", "left_anti")


def replace_by_source(store: DataFrame, new: DataFrame, current: DataFrame) -> DataFrame:
    """A store of findings by path, with those of new's paths replaced and those of vanished paths dropped."""
    kept = store.join(current.select("path"), "path", "left_semi").join(new.select("path").distinct(), "path", "left_anti")
    return kept.unionByName(new)


def complete_sessions(verdicts: DataFrame, behaviors: int = BEHAVIORS) -> DataFrame:
    """Sessions that have a verdict of every class: only these go into the ledger."""
    return verdicts.groupBy("session_ref").agg(F.countDistinct("behavior").alias("n")).where(F.col("n") == behaviors).select("session_ref")


def verdict_rollup(verdicts: DataFrame) -> DataFrame:
    """Each session's classes that fired, worst severity and judging models."""
    from tracewell.functions.text import severity_rank

    fired = verdicts.where("occurred = 1").withColumn("rank", severity_rank(F.col("severity")))
    return fired.groupBy("session_ref").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "behavior"))), lambda x: x["behavior"]), ",").alias("fired"),
        F.element_at(F.array(*map(F.lit, ("high", "med", "low", "unknown"))), (F.min("rank") + 1).cast("int")).alias("worst"), F.countDistinct("model").alias("models"),
    )


def judge_quality(votes: DataFrame) -> DataFrame:
    """votes(session_ref, behavior, occurred, truth): the majority of the runs against the truth, by class: recall of what is
    there and false alarms at what is not."""
    per = votes.groupBy("session_ref", "behavior").agg((F.avg("occurred") > 0.5).alias("fired"), F.max("truth").alias("truth"))
    return per.groupBy("behavior").agg(
        F.count("*").alias("cases"), F.avg(F.when(F.col("truth") == 1, F.col("fired").cast("double"))).alias("recall"), F.avg(F.when(F.col("truth") == 0, F.col("fired").cast("double"))).alias("false_alarms"),
    )


def store_summary(verdicts: DataFrame) -> DataFrame:
    """Verdicts and how many fired, of each judging model."""
    return verdicts.groupBy("model").agg(F.count("*").alias("verdicts"), F.count_if(F.col("occurred") == 1).alias("fired"))
