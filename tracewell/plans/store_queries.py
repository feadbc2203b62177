"""Queries over keyed stores, judges' verdicts and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import ml, scans, sessions, stores
from tracewell.plans.registry import ORACLES, query
from tracewell.sources.shared import new_folder

_MID = 1_705_276_800_000


def _marks(t, where):
    ref = sessions.session_ref(F.col("fleet"), F.col("session"))
    return t.ev.where("kind = 'operator_mark'").where(where).select(ref.alias("session_ref"), stores.rating(F.col("rating")).cast("long").alias("rating"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("note"), F.col("ts").alias("created_ms"))


_RATING = "CASE WHEN TRY_CAST(rating AS DOUBLE) IS NULL THEN 3 ELSE least(greatest(CAST(trunc(TRY_CAST(rating AS DOUBLE)) AS BIGINT), 1), 5) END"
_MARKS = f"mk AS (SELECT fleet || ':' || session AS session_ref, {_RATING} AS rating, 'm' || id AS note, ts AS created_ms, id FROM ev WHERE kind = 'operator_mark')"


@query("W17_latest_marks", f"WITH {_MARKS} SELECT session_ref, rating, note, created_ms FROM (SELECT *, row_number() OVER (PARTITION BY session_ref ORDER BY created_ms DESC, id DESC) AS r FROM mk) AS x WHERE r = 1")
def _(t):
    """Marks of even events from the log, of odd ones from the store."""
    return stores.latest_marks(_marks(t, "id % 2 = 0"), _marks(t, "id % 2 = 1"))


@query("S18_marks_upsert", f"WITH {_MARKS} SELECT session_ref, arg_max(rating, created_ms) AS rating, arg_max(note, created_ms) AS note, max(created_ms) AS created_ms FROM mk GROUP BY session_ref")
def _(t):
    """The month's first half as the store, the rest as what comes in."""
    first = stores.latest(_marks(t, F.col("ts") < _MID), ["session_ref"], F.desc("created_ms"))
    return stores.upsert(first, _marks(t, F.col("ts") >= _MID), ["session_ref"], "created_ms")


_LEDGER = f"cu AS (SELECT fleet || ':' || session AS path, max(ts) AS mtime FROM ev WHERE id % 7 <> 0 AND daemon <> 'd3' GROUP BY 1), le AS (SELECT fleet || ':' || session AS path, max(ts) AS mtime FROM ev WHERE ts < {_MID} GROUP BY 1)"


def _current(t):
    return t.ev.where("id % 7 <> 0 and daemon <> 'd3'").groupBy(sessions.session_ref(F.col("fleet"), F.col("session")).alias("path")).agg(F.max("ts").alias("mtime"))


def _ledger(t):
    return t.ev.where(F.col("ts") < _MID).groupBy(sessions.session_ref(F.col("fleet"), F.col("session")).alias("path")).agg(F.max("ts").alias("mtime"))


@query("J18_changed_sources", f"WITH {_LEDGER} SELECT cu.path, cu.mtime FROM cu LEFT JOIN le USING (path) WHERE le.mtime IS NULL OR cu.mtime > le.mtime ORDER BY mtime DESC, path")
def _(t):
    return stores.changed(_current(t), _ledger(t))


@query("U06_vanished_sources", f"WITH {_LEDGER} SELECT path, mtime FROM le ANTI JOIN cu USING (path)")
def _(t):
    return stores.vanished(_current(t), _ledger(t))


_VERDICTS = """ve AS (SELECT fleet || ':' || session AS session_ref, CASE k % 5 WHEN 0 THEN 'claims' WHEN 1 THEN 'loops' WHEN 2 THEN 'force' WHEN 3 THEN 'drift' ELSE 'noise' END AS behavior, CASE WHEN v % 3 = 0 THEN 1 ELSE 0 END AS occurred,
  CASE k % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'moderate' WHEN 2 THEN 'low' ELSE NULL END AS severity, 'judge-' || CAST(v % 2 AS STRING) AS model, id FROM {ev} WHERE kind = 'done')"""
_VERDICT_SQL = _VERDICTS.replace("{ev}", "ev") + ", vl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_ref, behavior ORDER BY id DESC) AS r FROM ve) AS x WHERE r = 1)"


def _verdicts(t):
    rows = t.spark.sql("WITH " + _VERDICTS + " SELECT * FROM ve", ev=t.ev)
    return stores.latest(rows, ["session_ref", "behavior"], F.desc("id"))


@query("S19_verdicts", f"WITH {_VERDICT_SQL} SELECT session_ref, behavior, occurred, severity, model, id FROM vl")
def _(t):
    return _verdicts(t)


@query("A34_verdict_rollup", f"""
WITH {_VERDICT_SQL}, fi AS (SELECT *, CASE severity WHEN 'high' THEN 0 WHEN 'moderate' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS rank FROM vl WHERE occurred = 1)
SELECT session_ref, string_agg(behavior, ',' ORDER BY rank, behavior) AS fired, ['high', 'med', 'low', 'unknown'][min(rank) + 1] AS worst, count(DISTINCT model) AS models FROM fi GROUP BY session_ref
""")
def _(t):
    return stores.verdict_rollup(_verdicts(t))


@query("S19_complete_sessions", f"WITH {_VERDICT_SQL} SELECT session_ref FROM vl GROUP BY session_ref HAVING count(DISTINCT behavior) = 5")
def _(t):
    return stores.complete_sessions(_verdicts(t))


@query("A56_store_summary", f"WITH {_VERDICT_SQL} SELECT model, count(*) AS verdicts, count(*) FILTER (occurred = 1) AS fired FROM vl GROUP BY model")
def _(t):
    return stores.store_summary(_verdicts(t))


_VOTES = """SELECT CAST(doc_id AS STRING) AS session_ref, b.behavior AS behavior, CASE WHEN b.behavior = 'quality' THEN quality ELSE toxic END AS truth,
  CASE WHEN (doc_id * 7 + r.r * 3) % 11 < 2 THEN 1 - (CASE WHEN b.behavior = 'quality' THEN quality ELSE toxic END) ELSE (CASE WHEN b.behavior = 'quality' THEN quality ELSE toxic END) END AS occurred
FROM {labels}, (SELECT 'quality' AS behavior UNION ALL SELECT 'toxic') AS b, (SELECT 0 AS r UNION ALL SELECT 1 UNION ALL SELECT 2) AS r"""


@query("A57_judge_quality", f"""
WITH vo AS ({_VOTES.replace("{labels}", "labels")}), p AS (SELECT session_ref, behavior, avg(occurred) > 0.5 AS fired, max(truth) AS truth FROM vo GROUP BY ALL)
SELECT behavior, count(*) AS cases, avg(CAST(fired AS DOUBLE)) FILTER (truth = 1) AS recall, avg(CAST(fired AS DOUBLE)) FILTER (truth = 0) AS false_alarms FROM p GROUP BY behavior
""")
def _(t):
    return stores.judge_quality(t.spark.sql(_VOTES, labels=t.table("labels")))


def _features(t):
    return sessions.session_features(t.ev)


_FEATURES = ORACLES["A11_session_features"]


def _moments(c: str) -> str:
    x = f"ln(1 + coalesce(CAST({c} AS DOUBLE), 0.0))" if c in ml.HEAVY else f"coalesce(CAST({c} AS DOUBLE), 0.0)"
    return f"CASE WHEN stddev_pop({x}) OVER () > 0 THEN ({x} - avg({x}) OVER ()) / stddev_pop({x}) OVER () ELSE 0.0 END"


ORACLES["M06_standardised"] = f"SELECT session_ref, provider, model, {', '.join(f'round({_moments(c)}, 6) AS z_{c}' for c in ml.NUMERIC)} FROM ({_FEATURES}) AS f"


@query("M06_standardised")
def _(t):
    z = ml.standardised(_features(t))
    return z.select("session_ref", "provider", "model", *[F.round(f"z_{c}", 6).alias(f"z_{c}") for c in ml.NUMERIC])


_Z = f"SELECT session_ref, provider, model, {', '.join(f'{_moments(c)} AS z_{c}' for c in ml.NUMERIC)} FROM ({_FEATURES}) AS f"
_EACH = ", ".join(f"{{'name': '{c}', 'z': round(z_{c}, 2)}}" for c in ml.NUMERIC)
ORACLES["M08_deviations"] = f"""
WITH z AS ({_Z}), u AS (SELECT session_ref, unnest([{_EACH}]) AS x FROM z), r AS (SELECT session_ref, x.name AS name, row_number() OVER (PARTITION BY session_ref ORDER BY -abs(x.z), x.name) AS k FROM u WHERE abs(x.z) >= 0.5),
w AS (SELECT session_ref, string_agg(name, ',' ORDER BY k) AS why FROM r WHERE k <= 3 GROUP BY session_ref)
SELECT session_ref, coalesce(why, '') AS why, count(*) OVER (PARTITION BY provider) < 0.1 * count(*) OVER () AS rare_provider, count(*) OVER (PARTITION BY model) < 0.1 * count(*) OVER () AS rare_model FROM z LEFT JOIN w USING (session_ref)
"""


@query("M08_deviations")
def _(t):
    return ml.deviations(ml.standardised(_features(t)))


@query("M07_isolation_scores")
def _(t):
    return ml.isolation_scores(ml.standardised(_features(t)))


@query("M09_worklist")
def _(t):
    return ml.worklist(ml.isolation_scores(ml.standardised(_features(t))), _marks(t, "true"))


def _joined(t):
    """Sessions with a label. They are written once, as every fit reads them many times."""
    label = scans.sentiment(t.ev, 1).select("session_ref", F.col("rate").alias("y"))
    rows, at = _features(t).join(label, "session_ref"), new_folder(t.spark, "labelled")
    rows.write.parquet(at)
    return t.spark.read.schema(rows.schema).parquet(at)


@query("M02_out_of_fold")
def _(t):
    return ml.out_of_fold(_joined(t))


@query("M04_regression_quality")
def _(t):
    return ml.regression_quality(ml.out_of_fold(_joined(t)))


@query("W25_residual_tails")
def _(t):
    return ml.residual_tails(ml.out_of_fold(_joined(t)))


@query("M05_unlabelled_scores")
def _(t):
    """Sessions without a label, scored by a model of those with one; the worst first."""
    joined = _joined(t)
    rest = _features(t).join(joined.select("session_ref"), "session_ref", "left_anti")
    return ml.scored_unlabelled(joined, rest)


@query("M03_importance")
def _(t):
    return ml.importance(_joined(t))


@query("T14_top_importances")
def _(t):
    return ml.top_importances(ml.importance(_joined(t)))


#: A score that engines work out alike stands for the forest's, whose own is tested by itself.
_SCORED = f"sc AS (SELECT session_ref, round(n_tasks * 3 + n_tools % 7 + cost, 2) AS score FROM ({_FEATURES}) AS f)"


@query("W15_ranked_worklist", f"""
WITH {_MARKS}, {_SCORED}, rk AS (SELECT session_ref, score, row_number() OVER (ORDER BY score DESC, session_ref) AS rank FROM sc), un AS (SELECT * FROM rk WHERE session_ref NOT IN (SELECT session_ref FROM mk))
SELECT session_ref, score, row_number() OVER (ORDER BY rank) AS place, rank FROM un ORDER BY rank LIMIT 30
""")
def _(t):
    """The worklist's ranks, among all sessions and among those without a mark."""
    scored = _features(t).select("session_ref", F.round(F.col("n_tasks") * 3 + F.col("n_tools") % 7 + F.col("cost"), 2).alias("score"))
    return ml.worklist(scored, _marks(t, "true"))


@query("M09_marked_scores", f"WITH {_MARKS}, {_SCORED} SELECT session_ref, score, session_ref IN (SELECT session_ref FROM mk) AS marked FROM sc")
def _(t):
    scored = _features(t).select("session_ref", F.round(F.col("n_tasks") * 3 + F.col("n_tools") % 7 + F.col("cost"), 2).alias("score"))
    return ml.by_mark(scored, _marks(t, "true"))


_PREDICTED = "pr AS (SELECT fleet || ':' || session AS session_ref, CAST(count(*) FILTER (kind = 'tool_call') * 7 % 41 - 20 AS DOUBLE) AS y, CAST(count(*) % 31 - 15 AS DOUBLE) AS pred FROM ev GROUP BY 1)"


def _predicted(t):
    """Numbers that stand for targets and predictions, so that what is made of them can be compared."""
    ref = sessions.session_ref(F.col("fleet"), F.col("session")).alias("session_ref")
    return t.ev.groupBy(ref).agg((F.count_if(F.col("kind") == "tool_call") * 7 % 41 - 20).cast("double").alias("y"), (F.count("*") % 31 - 15).cast("double").alias("pred"))


@query("M04_quality_of_given", f"""
WITH {_PREDICTED}, m AS (SELECT count(*) AS n, avg(y) AS mean, stddev_pop(y) AS sd, avg(abs(y - pred)) AS mae, avg((y - pred) * (y - pred)) AS mse FROM pr) SELECT n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mae, 6) AS mae, round(1 - mse / (sd * sd), 6) AS r2 FROM m
""")
def _(t):
    return ml.regression_quality(_predicted(t)).select("n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "mae", "r2")])


@query("W25_tails_of_given", f"""
WITH {_PREDICTED}, r AS (SELECT *, round(pred - y, 1) AS residual FROM pr)
SELECT * FROM (SELECT *, 'unnoticed' AS tail FROM r ORDER BY residual DESC, session_ref LIMIT 12) UNION ALL SELECT * FROM (SELECT *, 'overnoticed' AS tail FROM r ORDER BY residual, session_ref LIMIT 12)
""")
def _(t):
    return ml.residual_tails(_predicted(t))
