"""Streams: workers, streamed records, totals that change, the marks inbox and keyed tables, each against batch results."""

import json
import os

import pytest
from pyspark.sql import functions as F
from tests.test_operators import BASE, log
from tracewell.operators import panels
from tracewell.sources import transcripts
from tracewell.streaming import inbox, jobs, records, workers
from tracewell.streaming.tables import KeyedTable, upsert_stream

HOUR = 3_600_000


@pytest.fixture(autouse=True)
def one_partition(spark):
    """A small stream has no use for more, and each has a state store of its own to open."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_keyed_table_rewrites_what_a_batch_touches(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ["k"], buckets=8)
    assert table.read() is None
    table.merge(spark.range(100).selectExpr("id AS k", "0 AS v", "0 AS t"), 0, "t")
    table.merge(spark.createDataFrame([(5, 1, 1), (5, 2, 2), (200, 3, 1)], "k long, v int, t int"), 3, "t")
    got = {r["k"]: r["v"] for r in table.read().collect()}
    assert len(got) == 101 and got[5] == 2 and got[200] == 3 and got[6] == 0
    assert 1 <= list(table.versions().values()).count(3) <= 2 and len(table.versions()) == 8
    table.merge(spark.createDataFrame([(5, 9, 9)], "k long, v int, t int"), 3, "t")  # the same batch again
    assert {r["k"]: r["v"] for r in table.read().collect()} == got
    table.merge(spark.createDataFrame([], "k long, v int, t int"), 4, "t")
    assert max(table.versions().values()) == 3
    os.remove(f"{tmp_path}/t/manifests/version=3/_SUCCESS")  # a batch that didn't end leaves the table as it was
    assert table.read().count() == 100


def test_stores_fed_by_a_stream(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/store", ["k"])
    for version in ("a", "b"):
        log(tmp_path / "kv", f"{version}.jsonl", [{"kind": version}])
        rows = jobs.event_stream(spark, f"{tmp_path}/kv", "mu").select(F.lit("k").alias("k"), "kind", "ts")
        upsert_stream(rows, table, ["ts", "kind"], f"{tmp_path}/c").awaitTermination()
    assert [r["kind"] for r in table.read().collect()] == ["b"]


def worker_events(spark, path):
    payload = "model string, elapsed_ms long"
    return jobs.event_stream(spark, path, "mu").withColumn("p", F.from_json("payload", payload)).select("fleet", "session", "id", "ts", "kind", "p.model", "p.elapsed_ms")


def at(folder, name, rows):
    """rows: (id, hours, kind)"""
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(json.dumps({"id": i, "session_id": "s1", "timestamp_unix_ms": int(BASE + h * HOUR), "actor": "a", "payload": {"kind": k, "model": f"m{i}", "elapsed_ms": i}}) + "\n" for i, h, k in rows))


def test_stale_workers_are_told_once(spark, tmp_path):
    """Two daemons have sessions of one id; ends come in a later batch than starts, or never, or after all, or before them."""
    run = lambda: jobs.run_once(workers.outcomes(worker_events(spark, f"{tmp_path}/in"), "1 minute"), f"{tmp_path}/out", f"{tmp_path}/c")
    rows = lambda: sorted((r["session"], r["n"], r["outcome"], r["took"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    at(tmp_path / "in" / "d1", "a.jsonl", [(1, 0, "worker_spawned"), (2, 1, "worker_spawned"), (3, 2, "worker_exited")])
    at(tmp_path / "in" / "d2", "a.jsonl", [(1, 3, "worker_spawned"), (2, 4, "user_message")])
    run()
    assert rows() == [("d1:s1", 1, "exited", 3)]
    at(tmp_path / "in" / "d1", "b.jsonl", [(4, 6.5, "worker_spawned"), (5, 6.9, "worker_failed")])
    run()
    assert rows() == [("d1:s1", 1, "exited", 3), ("d1:s1", 2, "failed", 5)]
    at(tmp_path / "in" / "d3", "a.jsonl", [(1, 10, "worker_spawned")])
    run()  # 6 h after the start of d2's worker
    stale = [("d2:s1", 1, "unknown-stale", None)]
    assert [r for r in rows() if r[2] == "unknown-stale"] == stale
    at(tmp_path / "in" / "d2", "b.jsonl", [(9, 11, "worker_timeout")])
    run()
    assert [r for r in rows() if r[2] == "unknown-stale"] == stale and ("d2:s1", 1, "timeout", 9) in rows()
    at(tmp_path / "in" / "d4", "a.jsonl", [(1, 40, "worker_spawned")])
    run()
    events = [spark.read.schema("id long, session_id string, timestamp_unix_ms long, payload struct<kind string, model string, elapsed_ms long>").json(f"{tmp_path}/in/{d}").selectExpr("'mu' AS fleet", f"'{d}:s1' AS session", "id", "timestamp_unix_ms AS ts", "payload.*") for d in ("d1", "d2", "d3", "d4")]
    whole = events[0].union(events[1]).union(events[2]).union(events[3])
    batch = panels.delegations(whole, int(BASE + 40 * HOUR) - 60_000).where("outcome <> 'running'")
    key = lambda df: sorted(map(tuple, df.select("session", "n", "ts", "model", "outcome", "took").collect()), key=repr)
    assert key(workers.latest_outcomes(spark.read.parquet(f"{tmp_path}/out"))) == key(batch)


def test_worker_state_ends(spark, tmp_path):
    """A session of which nothing is heard for long is forgotten: a late end finds no worker."""
    run = lambda: jobs.run_once(workers.outcomes(worker_events(spark, f"{tmp_path}/in"), "1 minute", keep_ms=24 * HOUR), f"{tmp_path}/out", f"{tmp_path}/c")
    at(tmp_path / "in" / "d1", "a.jsonl", [(1, 0, "worker_spawned")])
    run()
    at(tmp_path / "in" / "d2", "a.jsonl", [(1, 50, "worker_spawned")])
    run()
    at(tmp_path / "in" / "d1", "b.jsonl", [(2, 51, "worker_exited")])
    run()
    assert [(r["session"], r["outcome"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("d1:s1", "unknown-stale")]


def said(pos, mid, n):
    usage = {"input_tokens": n, "output_tokens": 2 * n, "cache_creation_input_tokens": n, "cache_creation": {"ephemeral_5m_input_tokens": n}}
    return json.dumps({"type": "assistant", "timestamp": "2026-01-01T00:00:00Z", "message": {"id": mid, "model": "m-1", "content": "x", "usage": usage}})


def batch_totals(spark, path):
    got = transcripts.normalised(transcripts.read_records(spark, path)).where("kind = 'task_telemetry'")
    return sorted((r["session_id"], *[r[f] for f in records.FIELDS]) for r in got.collect())


def test_streamed_records_count_once_and_totals_are_sent_again(spark, tmp_path):
    """A message's records come growing, reordered and again; a file that grows is delivered anew and changes its session's total once."""
    src, ev = tmp_path / "in", lambda name: f"{tmp_path}/{name}"
    table = KeyedTable(spark, ev("totals"), ["session_id"])

    def run():
        stream = transcripts.read_records(spark, f"{src}/*", stream=True)
        jobs.run_once(records.usage_changes(stream), ev("changes"), ev("c1"))
        changes = spark.readStream.schema(records.LastRecords.SCHEMA).parquet(ev("changes"))
        records.keep_totals(changes, table, ev("c2"))
        return sorted((r["session_id"], *[r[f] for f in records.FIELDS]) for r in table.read().collect())

    lines = [said(0, "m1", 1), said(1, "m2", 5), said(2, "m1", 3), "", said(4, "m3", 7)]
    (src / "first").mkdir(parents=True)
    (src / "first" / "s.jsonl").write_text("\n".join(lines))
    (src / "first" / "t.jsonl").write_text(said(0, "m1", 100))
    assert run() == batch_totals(spark, f"{src}/first")
    n = len(table._committed())
    (src / "later").mkdir()
    (src / "later" / "s.jsonl").write_text("\n".join([*lines, said(5, "m3", 9), said(6, "m4", 1)]))
    assert run() == sorted(batch_totals(spark, f"{src}/later") + [r for r in batch_totals(spark, f"{src}/first") if r[0] == "t"])
    assert len(table._committed()) == n + 1
    changed = [r for r in spark.read.parquet(ev("changes")).collect() if r["message_id"] in ("m3", "m4")]
    assert sorted((r["message_id"], r["first"], r["prompt_tokens"]) for r in changed) == [("m3", False, 2), ("m3", True, 7), ("m4", True, 1)]
    (src / "third").mkdir()
    (src / "third" / "s.jsonl").write_text("\n".join(lines))  # an old copy comes late: nothing changes
    before = run()
    assert before == run() and len(table._committed()) == n + 1


def test_last_records_in_any_order(spark, tmp_path):
    schema = "session_id string, pos long, type string, message string"
    rows = [("s", p, "assistant", json.dumps({"id": m, "usage": {"input_tokens": n}})) for p, m, n in ((3, "a", 9), (1, "a", 4), (2, "a", 6), (5, "b", 1), (4, "b", 8))]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    jobs.run_once(records.usage_changes(stream), f"{tmp_path}/out", f"{tmp_path}/c")
    assert records.session_totals(spark.read.parquet(f"{tmp_path}/out")).select("messages", "prompt_tokens").first()[:] == (2, 10)


def test_marks_inbox(spark, tmp_path):
    """Bad lines are counted, the latest mark of an id counts, files that were taken in are moved, a rerun changes nothing."""
    box, archive = tmp_path / "inbox", tmp_path / "archive"
    box.mkdir()
    store, broken = KeyedTable(spark, f"{tmp_path}/marks", inbox.KEY), KeyedTable(spark, f"{tmp_path}/broken", ["file"])
    run = lambda: inbox.ingest(spark, str(box), str(archive), store, broken, f"{tmp_path}/c")
    marks = lambda: sorted((r["mark_id"], r["rating"], r["note"], r["session_ref"]) for r in store.read().collect())
    (box / "a.jsonl").write_text('{"task_id": "t1", "rating": 9, "daemon": "d", "session_id": "s", "created_at_unix_ms": 1}\nnot json\n\n[1]\n{"id": "t2", "rating": "abc", "note": "n", "session_id": "u"}\n{"ref": "mu:x:y"}\n')
    (box / "skipped.txt").write_text('{"id": "no"}')
    run()
    first = marks()
    assert [m[1:] for m in first if m[0].startswith("mark-")] == [(3, "", "mu:x:y")]
    assert [m for m in first if m[0].startswith("t")] == [("t1", 5, "", "mu:d:s"), ("t2", 3, "n", "cc:u")]
    assert [(r["file"], r["broken"]) for r in broken.read().collect()] == [("a.jsonl", 2)]
    run()
    assert marks() == first
    (box / "b.jsonl").write_text('{"task_id": "t1", "rating": 2, "session_ref": "cc:z", "created_at_unix_ms": 5}\n')
    run()
    run()
    assert ("t1", 2, "", "cc:z") in marks() and len(marks()) == 3
    left, moved = {p.name for p in box.rglob("*.jsonl")}, {p.name for p in archive.rglob("*.jsonl")}
    assert "a.jsonl" in moved and "a.jsonl" not in left and left | moved == {"a.jsonl", "b.jsonl"}
    assert (box / "skipped.txt").exists()


def test_expired_records_are_forgotten(spark, tmp_path):
    """Without its state a message's next record counts whole: the price of bounded state, paid after ttl_ms only."""
    schema = "session_id string, pos long, type string, message string"
    for i, (session, n) in enumerate((("s", 4), ("other", 1), ("s", 6))):
        spark.createDataFrame([(session, i, "assistant", json.dumps({"id": "a", "usage": {"input_tokens": n}}))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.run_once(records.usage_changes(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ttl_ms=1), f"{tmp_path}/out", f"{tmp_path}/c")
    assert {r["session_id"]: r["prompt_tokens"] for r in records.session_totals(spark.read.parquet(f"{tmp_path}/out")).collect()} == {"s": 10, "other": 1}


def test_state_of_many_sessions_in_one_bucket(spark, tmp_path, monkeypatch):
    """Sessions that share a bucket keep turns and usage of their own from batch to batch, and each is forgotten by its own time."""
    monkeypatch.setattr(jobs, "BUCKETS", 1)

    def send(folder, name, rows):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))

    def stream(folder, ddl):
        return spark.readStream.schema(ddl).json(f"{tmp_path}/{folder}")

    def turns(name, rows):
        send("ev", name, [{"fleet": "mu", "session": s, "id": i, "ts": 10 * i, "kind": k} for s, i, k in rows])
        jobs.run_once(jobs.turns(stream("ev", "fleet string, session string, id long, ts long, kind string")), f"{tmp_path}/t", f"{tmp_path}/tc")
        return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/t").select("session", "start_ms", "end_ms", "invocations").collect()))

    assert turns("a.json", [("a", 1, "user_message"), ("b", 1, "user_message"), ("b", 2, "assistant_message_event"), ("b", 3, "done")]) == [("b", 10, 30, 1)]
    assert turns("b.json", [("a", 2, "assistant_message_event"), ("a", 3, "user_message"), ("c", 9, "assistant_message_event")]) == [("a", 10, 20, 1), ("b", 10, 30, 1)]

    def totals(name, rows):
        send("rec", name, [{"session_id": s, "pos": p, "type": "assistant", "message": json.dumps({"id": m, "usage": {"input_tokens": n}})} for s, p, m, n in rows])
        jobs.run_once(records.usage_changes(stream("rec", "session_id string, pos long, type string, message string")), f"{tmp_path}/u", f"{tmp_path}/uc")
        return sorted((r["session_id"], r["messages"], r["prompt_tokens"]) for r in records.session_totals(spark.read.parquet(f"{tmp_path}/u")).collect())

    assert totals("a.json", [("a", 1, "m", 1), ("b", 1, "m", 5), ("a", 2, "m", 3)]) == [("a", 1, 3), ("b", 1, 5)]
    assert totals("b.json", [("b", 2, "m", 7), ("a", 1, "m", 1)]) == [("a", 1, 3), ("b", 1, 7)]
