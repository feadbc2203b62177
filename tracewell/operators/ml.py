"""Models over session features: anomaly scores with their reasons, and a regressor of signed sentiment."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

HEAVY = ("prompt_tokens", "completion_tokens", "cache_read_tokens", "cache_write_tokens", "n_tasks", "n_asks", "n_tools", "n_gaps", "latency_p50", "latency_p95", "max_context", "cost")
LIGHT = ("hour", "weekday")
NUMERIC = (*HEAVY, *LIGHT)
TREES, TREE_ROWS = 256, 256


def standardised(features: DataFrame) -> DataFrame:
    """session_ref and a z_ column for each numeric feature: heavy tails by log1p first, then by mean and population deviation.
    The moments are one row, found by one aggregate."""
    logs = features.select("session_ref", "provider", "model", *[F.log1p(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in HEAVY], *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in LIGHT])
    moments = logs.agg(*[F.avg(c).alias(f"m_{c}") for c in NUMERIC], *[F.stddev_pop(c).alias(f"s_{c}") for c in NUMERIC]).withColumn("_one", F.lit(1))
    both = logs.withColumn("_one", F.lit(1)).join(F.broadcast(moments), "_one")  # one row
    return both.select("session_ref", "provider", "model", *[F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0).alias(f"z_{c}") for c in NUMERIC])


def deviations(z: DataFrame, k: int = 3, least: float = 0.5) -> DataFrame:
    """Each session's k most deviant features, as text, and whether its provider or model is rare (under a tenth of sessions)."""
    n = z.agg(F.count("*").alias("n")).withColumn("_one", F.lit(1))
    rare = z.withColumn("_one", F.lit(1)).join(F.broadcast(n), "_one").withColumns({f"rare_{c}": F.count("*").over(Window.partitionBy(c)) < 0.1 * F.col("n") for c in ("provider", "model")})
    each = F.array(*[F.struct((-F.abs(F.round(f"z_{c}", 2))).alias("a"), F.lit(c).alias("name"), F.round(f"z_{c}", 2).alias("z")) for c in NUMERIC])
    best = F.slice(F.array_sort(F.filter(each, lambda x: x["a"] <= -least)), 1, k)
    return rare.select("session_ref", F.array_join(F.transform(best, lambda x: x["name"]), ",").alias("why"), "rare_provider", "rare_model")


def isolation_scores(z: DataFrame, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 42) -> DataFrame:
    """Isolation forest: each tree is grown in a group of its own, on at most `rows` sessions drawn by hash, and the forest's
    mean path lengths give the score (Liu, Ting and Zhou, 2008). Sampling is the method's own."""
    columns = [f"z_{c}" for c in NUMERIC]
    n = max(1, z.count())
    share = min(1.0, 1.3 * rows / n)
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    h = F.xxhash64(F.lit(seed), "session_ref", "tree")
    drawn = z.select("session_ref", *columns, tree.alias("tree")).where(F.shiftrightunsigned(h, 11) / F.lit(float(2**53)) < share).withColumn("h", F.xxhash64(F.lit(seed), "session_ref", "tree"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "session_ref"]).head(rows)
        number = int(pdf["tree"].iloc[0])
        rng, x = np.random.default_rng(seed * 1000 + number), pdf[columns].to_numpy()
        nodes, todo, most = [], [(np.arange(len(x)), 0)], int(np.ceil(np.log2(max(2, rows))))
        while todo:  # a node's children follow each other
            at, depth = todo.pop(0)
            spread = np.flatnonzero(x[at].max(axis=0) > x[at].min(axis=0)) if len(at) > 1 and depth < most else []
            if not len(spread):
                nodes.append((number, -1, 0.0, 0, depth + _path(len(at))))
                continue
            f = int(rng.choice(spread))
            cut = float(rng.uniform(x[at, f].min(), x[at, f].max()))
            nodes.append((number, f, cut, len(nodes) + len(todo) + 1, 0.0))
            todo += [(at[x[at, f] < cut], depth + 1), (at[x[at, f] >= cut], depth + 1)]
        return pd.DataFrame(nodes, columns=["tree", "feature", "cut", "child", "path"]).reset_index(names="node")

    grown = drawn.groupBy("tree").applyInPandas(grow, "node int, tree int, feature int, cut double, child int, path double")
    forest = [g.sort_values("node") for _, g in grown.toPandas().groupby("tree")]  # at most trees x 2 rows nodes
    norm = _path(min(rows, n))

    def score(batches):
        for pdf in batches:
            x, total = pdf[columns].to_numpy(), np.zeros(len(pdf))
            for t in forest:
                feature, cut, child, path = (t[c].to_numpy() for c in ("feature", "cut", "child", "path"))
                at = np.zeros(len(x), int)
                while (inner := feature[at] >= 0).any():
                    right = x[np.arange(len(x)), np.maximum(feature[at], 0)] >= cut[at]
                    at = np.where(inner, child[at] + right, at)
                total += path[at]
            yield pd.DataFrame({"session_ref": pdf["session_ref"], "score": 2 ** (-total / max(1, len(forest)) / norm)})

    return z.select("session_ref", *columns).mapInPandas(score, "session_ref string, score double")


def _path(n: int) -> float:
    """The mean depth of an unsuccessful search among n."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def worklist(scores: DataFrame, marked: DataFrame, limit: int = 30) -> DataFrame:
    """The most anomalous sessions without a mark, each with its rank among all. The limit is the feature.

    A session's rank is its place in the list plus the marked sessions before it: marked ones, which are few, are compared with
    the list alone, so that no task ranks all sessions."""
    known = marked.select("session_ref").distinct()
    top = scores.join(known, "session_ref", "left_anti").orderBy(F.desc("score"), "session_ref").limit(limit)
    place = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "session_ref")  # over `limit` rows
    top = top.withColumn("place", F.row_number().over(place).cast("long"))
    rest = scores.join(known, "session_ref", "left_semi").select(F.col("session_ref").alias("r"), F.col("score").alias("s"))
    before = (F.col("s") > F.col("score")) | ((F.col("s") == F.col("score")) & (F.col("r") < F.col("session_ref")))
    ahead = rest.join(F.broadcast(top), before).groupBy("session_ref").agg(F.count("*").alias("ahead"))
    return top.join(ahead, "session_ref", "left").select("session_ref", "score", "place", (F.col("place") + F.coalesce("ahead", F.lit(0))).alias("rank"))


def by_mark(scores: DataFrame, marked: DataFrame) -> DataFrame:
    """All scores, with whether the session is marked."""
    known = marked.select("session_ref").distinct().withColumn("_m", F.lit(True))
    return scores.join(known, "session_ref", "left").withColumn("marked", F.col("_m").isNotNull()).drop("_m")


def feature_pipeline() -> list:
    """Stages from session features to a vector: numbers, and providers and models one-hot."""
    return [
        StringIndexer(inputCols=["provider", "model"], outputCols=["provider_i", "model_i"], handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=["provider_i", "model_i"], outputCols=["provider_v", "model_v"]),
        VectorAssembler(inputCols=[*NUMERIC, "provider_v", "model_v"], outputCol="features"),
    ]


def out_of_fold(joined: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """joined: session features with y -> session_ref, y, pred, each row predicted by a model that has not seen it. Folds are
    by hash of the session, so that they don't depend on the order of rows."""
    rows = joined.fillna(0, subset=list(NUMERIC)).withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), "session_ref"), F.lit(folds)))
    parts = []
    for i in range(folds):
        model = Pipeline(stages=[*feature_pipeline(), GBTRegressor(labelCol="y", maxIter=10, maxDepth=3, seed=seed)]).fit(rows.where(F.col("fold") != i))
        parts.append(model.transform(rows.where(F.col("fold") == i)).select("session_ref", "y", F.col("prediction").alias("pred")))
    return reduce(DataFrame.union, parts)


def regression_quality(predicted: DataFrame) -> DataFrame:
    """R2, mean absolute error and the target's mean and deviation."""
    m = predicted.agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("sd"), F.avg(F.abs(F.col("y") - F.col("pred"))).alias("mae"), F.avg((F.col("y") - F.col("pred")) ** 2).alias("mse"))
    return m.select("n", "mean", "sd", "mae", (1 - F.try_divide("mse", F.col("sd") ** 2)).alias("r2"))


def residual_tails(predicted: DataFrame, k: int = 12) -> DataFrame:
    """The k largest residuals on either side. The limit is the feature."""
    r = predicted.withColumn("residual", F.round(F.col("pred") - F.col("y"), 1))
    high = r.orderBy(F.desc("residual"), "session_ref").limit(k).withColumn("tail", F.lit("unnoticed"))
    return high.unionByName(r.orderBy("residual", "session_ref").limit(k).withColumn("tail", F.lit("overnoticed")))


def _fitted(joined: DataFrame, seed: int):
    return Pipeline(stages=[*feature_pipeline(), GBTRegressor(labelCol="y", maxIter=10, maxDepth=3, seed=seed)]).fit(joined.fillna(0, subset=list(NUMERIC)))


def scored_unlabelled(joined: DataFrame, rest: DataFrame, seed: int = 42) -> DataFrame:
    """Predictions for sessions that have no label, ranked from the lowest."""
    out = _fitted(joined, seed).transform(rest.fillna(0, subset=list(NUMERIC))).select("session_ref", F.col("prediction").alias("pred"))
    return out.orderBy("pred", "session_ref")


def importance(joined: DataFrame, repeats: int = 10, block_rows: int = 10_000, seed: int = 42) -> DataFrame:
    """How much the squared error grows when one feature's values are shuffled: feature, importance. Values are shuffled within
    blocks of about block_rows sessions, each of them a group, so that no task orders them all; a session travels once, with
    the hashes that give its place in each shuffle, and becomes a row for each feature and repeat after that."""
    model = _fitted(joined, seed)
    rows = joined.fillna(0, subset=list(NUMERIC)).select("session_ref", "provider", "model", "y", *[F.col(c).cast("double").alias(c) for c in NUMERIC])
    blocks = max(1, rows.count() // block_rows)
    rows = PipelineModel(model.stages[:2]).transform(rows)  # what no shuffle changes
    cases = [(f, r) for f in NUMERIC for r in range(1, repeats + 1)]
    places = F.array(*[F.xxhash64(F.lit(seed), F.lit(r), F.lit(f), "session_ref") for f, r in cases])
    kept = ["session_ref", "y", "provider_v", "model_v", *NUMERIC]
    blocked = rows.select(*kept, places.alias("places"), F.pmod(F.xxhash64(F.lit(seed), "session_ref"), F.lit(blocks)).alias("block"))

    def shuffled(block: pa.Table) -> pa.Table:
        names = block.column("session_ref").to_pandas().str.encode("utf-8").to_numpy()
        block = block.take(pa.array(np.argsort(names, kind="stable")))
        places = block.column("places").combine_chunks().flatten().to_numpy().reshape(block.num_rows, -1)
        values = np.column_stack([block.column(f).to_numpy()[np.argsort(places[:, i], kind="stable")] for i, (f, _) in enumerate(cases)])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(block.num_rows + 1, dtype=np.int32) * len(cases)), pa.array(values.ravel()))
        return block.select(kept).append_column("values", lists)

    mixed = blocked.groupBy("block").applyInArrow(shuffled, StructType([*blocked.select(*kept).schema.fields, StructField("values", ArrayType(DoubleType()))]))
    # The last case leaves all as it is.
    long = mixed.select(*kept, F.posexplode(F.concat("values", F.array(F.lit(0.0)))).alias("i", "v")).withColumn("f", F.element_at(F.array(*[F.lit(f) for f in (*NUMERIC, "")]), F.floor(F.col("i") / repeats).cast("int") + 1))
    long = long.withColumns({c: F.when(F.col("f") == c, F.col("v")).otherwise(F.col(c)) for c in NUMERIC})
    error = PipelineModel(model.stages[2:]).transform(long).groupBy("f").agg(F.avg((F.col("y") - F.col("prediction")) ** 2).alias("e"))
    plain = F.max(F.when(F.col("f") == "", F.col("e"))).over(Window.partitionBy())  # over one row a feature
    return error.withColumn("importance", F.col("e") - plain).where("f <> ''").select(F.col("f").alias("feature"), "importance")


def top_importances(found: DataFrame, most: int = 12) -> DataFrame:
    """The features that matter most. The limit is the feature."""
    return found.orderBy(F.desc("importance"), "feature").limit(most)
