"""Event logs, streams, stores and models on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F
from tracewell import dims
from tracewell.functions import text
from tracewell.operators import ml, panels, sessions, stores, timings
from tracewell.sources import events
from tracewell.streaming import jobs

BASE = 1_700_000_000_000


def log(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join((r if isinstance(r, str) else json.dumps({"id": i + 1, "session_id": name.removesuffix(".jsonl"), "timestamp_unix_ms": BASE + i * 60_000, "actor": "agent", "payload": r})) + "\n" for i, r in enumerate(rows)))


@pytest.fixture
def ev(spark, tmp_path):
    tel = {"kind": "task_telemetry", "task_id": "t1", "model": "claude-opus-4-8-20260101", "provider_kind": "anthropic_api", "prompt_tokens": 1_000_000, "completion_tokens": 0, "cache_read_tokens": 0, "cache_write_tokens": 0}
    rows = [{"kind": "session_created"}, {"kind": "user_message", "content": "stop"}, {"kind": "done", "stop_reason": "end_turn", "elapsed_ms": 2000}, {"kind": "done", "stop_reason": "aborted", "elapsed_ms": 4000}, tel, "not json"]
    log(tmp_path / "mu" / "d1", "s1.jsonl", rows)
    log(tmp_path / "mu" / "d2", "s1.jsonl", rows[:3])
    log(tmp_path / "cc" / "claude-code", "u1.jsonl", rows[:2])
    return events.connect(spark, {"mu": f"{tmp_path}/mu/*/*.jsonl", "cc": f"{tmp_path}/cc/*/*.jsonl", "none": f"{tmp_path}/absent/*.jsonl"})


def test_logs_of_two_fleets_are_one_relation(ev):
    assert ev.count() == 10  # the broken line is skipped
    assert {(r["fleet"], r["session"]) for r in ev.select("fleet", "session").distinct().collect()} == {("mu", "d1:s1"), ("mu", "d2:s1"), ("cc", "u1")}


def test_payloads_become_columns(spark, ev):
    wide = events.typed(ev).withColumnsRenamed({"provider_kind": "provider", "token_count_estimate": "token_count"})
    assert {r["stop_reason"]: r["n"] for r in panels.stop_reasons(wide).collect()} == {"end_turn": 2, "aborted": 1}
    row = sessions.session_features(wide).collect()
    assert len(row) == 1 and row[0]["latency_p50"] == 3000 and row[0]["cost"] == 5.0 and row[0]["cost_kind"] == "billed" and row[0]["session_ref"] == "mu:d1:s1"


def test_prices(spark):
    rows = [("anthropic/claude-haiku-4-5-x", 10**6, 10**6, 10**6, 10**6), ("nobody", 1, 1, 1, 1), (None, 1, 1, 1, 1), ("GPT-5.4-mini", 10**6, 0, 0, 0)]
    df = dims.priced(spark.createDataFrame(rows, "model string, prompt_tokens long, completion_tokens long, cache_read_tokens long, cache_write_tokens long"))
    got = {r["model"]: (r["rate_key"], r["cost"]) for r in df.collect()}
    assert got["anthropic/claude-haiku-4-5-x"] == ("claude-haiku-4-5", pytest.approx(1 + 5 + 0.1 + 1.25)) and got["nobody"] == (None, 0.0) and got[None] == (None, 0.0) and got["GPT-5.4-mini"] == ("gpt-5.4-mini", 0.75)


def test_ratings_and_endings(spark):
    df = spark.createDataFrame([("4",), ("0",), ("9",), ("abc",), (None,), ("4.0",)], "r string")
    assert [r[0] for r in df.select(stores.rating(F.col("r"))).collect()] == [4, 1, 5, 3, 3, 4]
    said = spark.createDataFrame([("thanks, good night",), ("no.\n",), ("and on",), ("",), (None,)], "t string")
    assert [r[0] for r in said.select(text.ending(F.col("t"))).collect()] == ["signoff", "ABRUPT+frustrated", "abrupt", "?", "?"]


def test_upsert_twice_is_once(spark):
    store, new = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int"), spark.createDataFrame([(2, "c", 2), (3, "d", 2), (3, "e", 3)], "k int, v string, t int")
    once = stores.upsert(store, new, ["k"], "t")
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "c", 2), (3, "e", 3)] == sorted(map(tuple, stores.upsert(once, new, ["k"], "t").collect()))


def test_invocations_consume_a_start_once(spark):
    rows = [(1, "provider_status_update", 0, "awaiting_first_token", None), (2, "provider_status_update", 1000, "streaming", None), (3, "assistant_message_event", 3000, None, 100), (4, "assistant_message_event", 3500, None, 7), (5, "provider_status_update", 4000, "awaiting_first_token", None), (6, "provider_status_update", 4500, "streaming", None), (7, "assistant_message_event", 6000, None, 50)]
    df = spark.createDataFrame([("mu", "s", *r) for r in rows], "fleet string, session string, id long, kind string, ts long, state string, output_tokens long")
    assert [(r["duration_ms"], r["ttft_ms"], r["tokens"]) for r in timings.invocations(df).orderBy("call").collect()] == [(3000, 1000, 100), (2000, 500, 50)]


def test_isolation_finds_the_odd_one(spark):
    rows = [(f"s{i}", "p", "m", *[0.1 * ((i * k) % 7) for k in range(len(ml.NUMERIC))]) for i in range(200)] + [("odd", "p", "m", *[9.0] * len(ml.NUMERIC))]
    z = spark.createDataFrame(rows, ["session_ref", "provider", "model", *[f"z_{c}" for c in ml.NUMERIC]])
    assert ml.isolation_scores(z, trees=32, rows=64).orderBy(F.desc("score")).first()["session_ref"] == "odd"


def test_streams_equal_batches(spark, tmp_path):
    rows = [{"kind": "user_message"}, {"kind": "assistant_message_event"}, {"kind": "assistant_message_event"}, {"kind": "done", "stop_reason": "aborted"}, {"kind": "user_message"}, {"kind": "assistant_message_event"}, {"kind": "user_message"}]
    log(tmp_path / "in" / "d1", "s1.jsonl", rows)
    log(tmp_path / "in" / "d1", "s2.jsonl", rows[:4])
    stream = lambda: jobs.event_stream(spark, f"{tmp_path}/in", "mu")
    jobs.run_once(stream(), f"{tmp_path}/ev", f"{tmp_path}/c1")
    assert spark.read.parquet(f"{tmp_path}/ev").count() == 11
    log(tmp_path / "in" / "d1", "s3.jsonl", rows[:2])
    jobs.run_once(stream(), f"{tmp_path}/ev", f"{tmp_path}/c1")  # takes up where it ended
    assert spark.read.parquet(f"{tmp_path}/ev").count() == 13


def test_daily_metrics_and_inactivity_stream(spark, tmp_path):
    log(tmp_path / "in" / "d", "s1.jsonl", [{"kind": "done", "stop_reason": "aborted"}, {"kind": "done", "stop_reason": "end_turn"}])
    (tmp_path / "in" / "d" / "s9.jsonl").write_text(json.dumps({"id": 1, "session_id": "s9", "timestamp_unix_ms": BASE + 10 * 86_400_000, "actor": "x", "payload": {"kind": "done"}}) + "\n")
    stream = jobs.event_stream(spark, f"{tmp_path}/in", "mu")
    q = jobs.daily_degradation(stream).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["n"], r["rate"]) for r in spark.table("daily").collect()} == {(2, 0.5), (1, None)}
    jobs.run_once(jobs.inactivity_sessions(jobs.event_stream(spark, f"{tmp_path}/in", "mu")), f"{tmp_path}/quiet", f"{tmp_path}/c")
    assert [(r["session"], r["events"]) for r in spark.read.parquet(f"{tmp_path}/quiet").collect()] == [("d:s1", 2)]


def test_turns_stream(spark, tmp_path):
    rows = [{"kind": "user_message"}, {"kind": "assistant_message_event"}, {"kind": "assistant_message_event"}, {"kind": "done"}, {"kind": "user_message"}, {"kind": "assistant_message_event"}, {"kind": "user_message"}]
    log(tmp_path / "in" / "d", "s1.jsonl", rows)
    log(tmp_path / "in" / "e", "s1.jsonl", rows[:2])  # another daemon's session of the same id
    jobs.run_once(jobs.turns(jobs.event_stream(spark, f"{tmp_path}/in", "mu")), f"{tmp_path}/turns", f"{tmp_path}/c")
    got = sorted((r["session"], r["start_ms"] - BASE, r["end_ms"] - BASE, r["invocations"]) for r in spark.read.parquet(f"{tmp_path}/turns").collect())
    assert got == [("d:s1", 0, 180_000, 2), ("d:s1", 240_000, 300_000, 1)]


def test_quantiles_equal_numpy(spark):
    """Ties, negative numbers, one value, nulls in the group, values of one bin; no task sorts a whole group."""
    import random

    import numpy as np
    from tracewell.operators import quantiles as qs

    r = random.Random(4)
    rows = [(g, r.choice((r.gauss(0, 1000), float(r.randrange(5)), -7.5, 1e12 + r.random()))) for g in ("a", None, "c") for _ in range(400)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    ps = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]
    got = {x["g"]: x["q"] for x in qs.quantiles(qs.counted(df, ["g"]), ["g"], ps).collect()}
    near = {x["g"]: x["q"] for x in qs.quantiles(qs.counted(df, ["g"]), ["g"], ps, nearest=True).collect()}
    assert set(got) == {"a", None, "c", "one"} == set(near)
    for g in got:
        values = sorted(v for k, v in rows if k == g)
        assert got[g] == pytest.approx(np.quantile(values, ps)) and near[g] == [values[min(len(values) - 1, int(p * len(values)))] for p in ps]
    whole = qs.quantiles(qs.counted(df, []), [], [0.5]).collect()
    assert whole[0]["q"] == pytest.approx([np.median([v for _, v in rows if v is not None])])
