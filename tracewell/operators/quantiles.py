"""Exact quantiles without a task that holds all values.

Values are counted by value. Each is in a bin of BINS to a power of two, whose counts are few; cumulated, they tell which bin a
rank falls in. Then only those bins' values are cumulated, bin by bin, and the value at the rank is picked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins to each power of two: a bin spans values of a few percent.
BINS = 32


def stacked(df: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """(by, metric, v): several numbers of a row as rows, without nulls and what is no number."""
    each = F.array(*[F.struct(F.lit(k).alias("metric"), c.cast("double").alias("v")) for k, c in values.items()])
    rows = df.select(*by, F.explode(each).alias("x")).select(*by, "x.metric", "x.v")
    return rows.where(F.col("v").isNotNull() & ~F.isnan("v"))


def counted(df: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """(by, v, n): how often each value occurs."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))


def quantiles(counts: DataFrame, by: list[str], ps: list[float], nearest: bool = False) -> DataFrame:
    """(by, q): of counts(by, v, n) each group's quantiles in order of ps, between two values in proportion or, if nearest, the
    value at min(N - 1, floor(p N)). Nulls in by are a group of their own."""
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))
    bin_of = F.floor(F.signum("v") * F.log2(1 + F.abs("v")) * BINS)
    rows = counts.select(group.alias("g"), "v", "n", bin_of.alias("bin"))
    upto = Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = rows.groupBy("g", "bin").agg(F.sum("n").alias("n")).withColumns({"upto": F.sum("n").over(upto), "of": F.sum("n").over(Window.partitionBy("g"))})

    def places(i: int, p: float) -> list[Column]:
        at = F.least(F.col("of") - 1, F.floor(F.lit(p) * F.col("of"))) if nearest else F.lit(p) * (F.col("of") - 1)
        low = F.floor(at).cast("long")
        return [F.struct(F.lit(i).alias("i"), F.lit(high).alias("high"), (F.ceil(at).cast("long") if high else low).alias("r"), (at - low).cast("double").alias("part")) for high in (False, True)]

    asked = bins.select("g", "bin", (F.col("upto") - F.col("n")).alias("before"), "upto", F.explode(F.array(*[x for i, p in enumerate(ps) for x in places(i, p)])).alias("x")).where("x.r >= before and x.r < upto")
    inside = Window.partitionBy("g", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    wanted = asked.select("g", "bin", "before", "x.*")
    near = rows.join(wanted.select("g", "bin").distinct(), ["g", "bin"], "left_semi").withColumn("c", F.sum("n").over(inside))
    picked = near.join(wanted, ["g", "bin"]).where("r >= before + c - n and r < before + c")
    each = picked.groupBy("g", "i").agg(F.max(F.when(~F.col("high"), F.col("v"))).alias("a"), F.max(F.when(F.col("high"), F.col("v"))).alias("b"), F.max("part").alias("part"))
    done = each.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("q")))).alias("q"))
    return done.select(*[F.col(f"g.{c}") for c in by], F.transform("q", lambda x: x["q"]).alias("q"))


def by_metric(quantiled: DataFrame, by: list[str], names: dict[str, list[str]]) -> DataFrame:
    """(by, a column for each name): quantiles of stacked metrics side by side."""
    cols = [F.max(F.when(F.col("metric") == m, F.col("q")[i])).alias(n) for m, ns in names.items() for i, n in enumerate(ns) if n]
    return quantiled.groupBy(*by).agg(*cols)
