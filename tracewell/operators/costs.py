"""Costs: rollups of the task table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Outcomes that claim what was not done.
HALLUCINATED = ("narrative_no_action", "hollow_commit", "lying_state")


def cost_sum() -> Column:
    """The sum of costs in units of 1e-10 USD, so that it does not depend on the order of rows."""
    return (F.sum(F.round(F.col("cost") * 1e10).cast("long")) / 1e10).alias("cost")


def rollups(tasks: DataFrame) -> DataFrame:
    """Tasks and cost by kind, by fleet and by fleet and model: three grains of one scan."""
    g = tasks.groupingSets([("cost_kind",), ("fleet",), ("fleet", "model")], "cost_kind", "fleet", "model")
    return g.agg(F.grouping_id().cast("long").alias("grain"), F.count("*").alias("tasks"), cost_sum())


def outcomes(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("outcome_class").agg(F.count("*").alias("n"))


def hallucination(tasks: DataFrame, least: int = 3, limit: int = 10) -> DataFrame:
    """Share of tool-using tasks whose outcome claims what was not done."""
    out = tasks.where("tool_calls > 0").groupBy("fleet", "model").agg(F.count_if(F.col("outcome_class").isin(*HALLUCINATED)).alias("flagged"), F.count("*").alias("n"))
    out = out.where(F.col("n") >= least).withColumn("rate", F.col("flagged") / F.col("n"))
    return out.orderBy(F.desc("rate"), F.desc("n"), "fleet", "model").limit(limit)


def trend(tasks: DataFrame, degradation: DataFrame) -> DataFrame:
    """Cost by day, with the day's share of bad endings (0 where there is none)."""
    per = tasks.groupBy("day").agg(F.count("*").alias("tasks"), cost_sum())
    return per.join(degradation.select("day", "rate"), "day", "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))


def totals(tasks: DataFrame) -> DataFrame:
    return tasks.agg(F.count("*").alias("tasks"), cost_sum(), F.count_if("is_priced").alias("priced"))


def unpriced(tasks: DataFrame) -> DataFrame:
    """Models without a rate: reported, never dropped."""
    return tasks.where(~F.col("is_priced")).groupBy("provider", "model").agg(F.count("*").alias("tasks"), F.sum("prompt_tokens").alias("prompt_tokens"))


def costliest(tasks: DataFrame, limit: int = 8) -> DataFrame:
    per = tasks.groupBy("fleet", "session").agg(F.count("*").alias("tasks"), cost_sum())
    return per.orderBy(F.desc("cost"), "fleet", "session").limit(limit)
