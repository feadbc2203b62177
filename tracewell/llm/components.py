"""Connected components by alternating large stars and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import durable

#: Into how many parts the edges of a node are dealt.
PARTS = 64


def _with_least(edges: DataFrame) -> DataFrame:
    """edges(u, v) with m, the least v of each u. A node's edges are dealt out in PARTS parts, each of which learns m by a row of
    its own, so that no task gets all edges of a hub."""
    edges = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int"))
    parts = edges.groupBy("u", "part").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("part").alias("parts"))  # PARTS at most
    return edges.join(least.select("u", "m", F.explode("parts").alias("part")), ["u", "part"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is joined to the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is joined to the least of them. Edges have u > v."""
    known = _with_least(edges)
    own = F.struct(F.col("u").alias("u"), F.col("m").alias("v"))
    moved = F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
    return known.select(F.explode(F.array(own, moved)).alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of longs -> u, v: each node that has an edge and isn't the least of its component, and that least node.

    Each round is written to the shared folder, which cuts the lineage; rounds go on until one changes no edge."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = durable(e, "edges")
    while True:
        new = durable(_small_star(_large_star(e)), "edges")
        if new.count() == e.count() and new.join(e, ["u", "v"], "left_anti").isEmpty():
            return new
        e = new
