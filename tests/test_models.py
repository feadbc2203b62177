"""Models against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.oracle import SF_DIR
from tests.test_queries import needs_data
from tracewell.operators import ml


def sample(spark, n=150, seed=3):
    r = np.random.default_rng(seed)
    cols = r.gamma(2.0, 3.0, (n, len(ml.NUMERIC)))
    y = cols[:, ml.NUMERIC.index("n_tools")] * 4 + (cols[:, ml.NUMERIC.index("cost")] > 6) * 10
    rows = [(f"s{i:03d}", "p" + str(i % 3), "m" + str(i % 2), *map(float, c), float(v)) for i, (c, v) in enumerate(zip(cols, y, strict=True))]
    return spark.createDataFrame(rows, ["session_ref", "provider", "model", *ml.NUMERIC, "y"])


def test_folds_never_see_what_they_predict(spark):
    """Out of fold, each session has one prediction, by a model of the other folds alone: its own label doesn't move it."""
    df = sample(spark).persist()
    first = {r["session_ref"]: (r["y"], r["pred"]) for r in ml.out_of_fold(df, folds=2).collect()}
    assert len(first) == 150
    fold = F.pmod(F.xxhash64(F.lit(42), "session_ref"), F.lit(2))
    mine = {r["session_ref"] for r in df.where(fold == 0).select("session_ref").collect()}
    moved = {r["session_ref"]: r["pred"] for r in ml.out_of_fold(df.withColumn("y", F.when(fold == 0, F.col("y") + 1000).otherwise(F.col("y"))), folds=2).collect()}
    assert all(moved[k] == pytest.approx(first[k][1]) for k in mine) and all(abs(moved[k] - first[k][1]) > 500 for k in set(first) - mine)
    q = ml.regression_quality(spark.createDataFrame([(k, *v) for k, v in first.items()], "session_ref string, y double, pred double")).first()
    y, p = np.array([v[0] for v in first.values()]), np.array([v[1] for v in first.values()])
    assert (q["mae"], q["sd"], q["r2"]) == pytest.approx((np.abs(y - p).mean(), y.std(), 1 - ((y - p) ** 2).mean() / y.var()))
    assert q["r2"] > 0.5


def test_importance_finds_what_matters(spark):
    top = [r["feature"] for r in ml.top_importances(ml.importance(sample(spark)), 2).collect()]
    assert top == ["n_tools", "cost"]


def plain_depths(x, rows, rng, limit):
    """Isolation trees by recursion over level order, and the path length of each row of x."""
    todo, depth = [(rows, np.arange(len(x)), 0)], np.zeros(len(x))
    while todo:
        mine, everyone, d = todo.pop(0)
        spread = np.flatnonzero(mine.max(axis=0) > mine.min(axis=0)) if len(mine) > 1 and d < limit else []
        if not len(spread):
            depth[everyone] = d + ml._path(len(mine))
            continue
        f = rng.choice(spread)
        cut = rng.uniform(mine[:, f].min(), mine[:, f].max())
        todo += [(mine[mine[:, f] < cut], everyone[x[everyone, f] < cut], d + 1), (mine[mine[:, f] >= cut], everyone[x[everyone, f] >= cut], d + 1)]
    return depth


def test_isolation_scores_equal_numpy(spark):
    """With as many rows a tree as there are sessions, every tree is grown on all of them, in order of their hash."""
    z = ml.standardised(sample(spark, 60)).persist()
    got = {r["session_ref"]: r["score"] for r in ml.isolation_scores(z, trees=8, rows=60, seed=5).collect()}
    columns = [f"z_{c}" for c in ml.NUMERIC]
    total = np.zeros(60)
    names, x = None, None
    for tree in range(8):
        ordered = z.orderBy(F.xxhash64(F.lit(5), "session_ref", F.lit(tree)), "session_ref").toPandas()
        if names is None:
            names, x = ordered["session_ref"].tolist(), ordered[columns].to_numpy()
        total += plain_depths(x, ordered[columns].to_numpy(), np.random.default_rng(5000 + tree), int(np.ceil(np.log2(60))))
    expected = dict(zip(names, 2 ** (-total / 8 / ml._path(60)), strict=True))
    assert got == pytest.approx(expected)


def test_ranks_of_the_worklist(spark):
    scores = spark.createDataFrame([(f"s{i}", float(i % 5)) for i in range(20)], "session_ref string, score double")
    marked = spark.createDataFrame([("s4",), ("s9",), ("s3",), ("s3",)], "session_ref string")
    order = sorted(range(20), key=lambda i: (-(i % 5), f"s{i}"))
    expected = [(f"s{i}", k + 1) for k, i in enumerate(order) if i not in (3, 4, 9)][:6]
    assert [(r["session_ref"], r["rank"]) for r in ml.worklist(scores, marked, 6).orderBy("place").collect()] == expected
    assert ml.by_mark(scores, marked).where("marked").count() == 3


@needs_data
def test_labelled_sessions_are_worked_out_once(spark):
    """Fits read what was written, not the events again."""
    from tracewell.plans import store_queries
    from tracewell.plans.registry import Tables

    rows = store_queries._joined(Tables(spark, SF_DIR))
    assert rows.count() and not any("events.parquet" in f for f in rows.inputFiles())
