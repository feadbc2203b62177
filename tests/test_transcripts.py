import json

from tests.oracle import SF_DIR
from tests.test_queries import needs_data
from tracewell.sources import transcripts


def record(session, pos, kind, message, meta=False):
    return (session, pos, kind, f"2026-01-01T00:00:{pos:02d}Z", meta, json.dumps(message))


def test_a_tool_round_trip_keeps_everything(spark):
    usage = lambda n: {"input_tokens": n, "output_tokens": 2 * n, "cache_read_input_tokens": 0}
    rows = [
        record("s", 0, "user", {"role": "user", "content": "do it"}),
        record("s", 1, "assistant", {"id": "m1", "model": "x-1", "stop_reason": None, "content": [{"type": "text", "text": "let me"}], "usage": usage(1)}),
        record("s", 2, "assistant", {"id": "m1", "model": "x-1", "stop_reason": "tool_use", "content": [{"type": "text", "text": "let me look"}, {"type": "tool_use", "id": "c1", "name": "Read", "input": {"path": "a"}}], "usage": usage(5)}),
        record("s", 3, "user", {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c1", "content": [{"type": "text", "text": "A"}, {"type": "text", "text": "B"}], "is_error": True}]}),
        record("s", 4, "assistant", {"id": "m2", "model": "x-1", "stop_reason": "stop_sequence", "content": [{"type": "text", "text": "done"}, {"type": "image"}], "usage": usage(7)}),
        record("s", 5, "summary", {}),
        record("s", 6, "user", {"role": "user", "content": "<system-reminder>x"}),
        record("t", 0, "user", {"role": "user", "content": "hello"}, True),
    ]
    df = spark.createDataFrame(rows, "session_id string, pos long, type string, timestamp string, isMeta boolean, message string")
    got = [(r["session_id"], r["id"], r["kind"], r["content"], r["name"], r["stop_reason"]) for r in transcripts.normalised(df).orderBy("session_id", "id").collect()]
    assert got == [
        ("s", 1, "session_created", None, None, None), ("s", 2, "user_message", "do it", None, None), ("s", 3, "assistant_message_event", "let me look", None, "tool_use"), ("s", 4, "tool_call", None, "Read", None), ("s", 5, "tool_result", "A\nB", "Read", None),
        ("s", 6, "assistant_message_event", "done\n[cc-unmapped-block:image]", None, "end_turn"), ("s", 7, "done", None, None, "end_turn"), ("s", 8, "user_message", "<system-reminder>x", None, None), ("s", 9, "task_telemetry", None, None, None),
    ]
    last = transcripts.normalised(df).where("kind = 'task_telemetry'").first()
    assert (last["prompt_tokens"], last["completion_tokens"], last["model"]) == (12, 24, "x-1")  # the streamed record counts once
    assert {r["type"]: r["n"] for r in transcripts.skipped(df).collect()} == {"summary": 1}
    assert {r["type"]: r["n"] for r in transcripts.unmapped(df).collect()} == {"image": 1}
    assert [r["meta"] for r in transcripts.normalised(df).where("kind = 'user_message'").orderBy("session_id", "id").collect()] == [None, "true"]


def test_reports_of_files(spark):
    from tracewell.operators import reports

    files = spark.createDataFrame([("/x/incident-2026-01-02-slow.md", "# Slow\nmu:d1:s1 and mu:d1/s1, cc:01234567-89ab-cdef-0123-456789abcdef or mu:d2/s2."), ("/x/odd-2026-01-02-a.md", "# A"), ("/x/incident-undated.md", "# B")], "path string, text string")
    got = reports.incidents(files, {"incident": "bad", "checkpoint": "good"}).collect()
    assert [(r["title"], r["polarity"], r["slug"], r["session_refs"]) for r in got] == [("Slow", "bad", "slow", ["mu:d1:s1", "cc:01234567-89ab-cdef-0123-456789abcdef", "mu:d2:s2"])]


def test_billed_usage(spark):
    m = 10**6
    day = spark.createDataFrame([("2026-01-01T00:00:00Z", [("opus-x", m, m, m, (m, m), "1234"), ("other", m, 0, 0, None, "x")])], "starting_at string, results array<struct<model string, uncached_input_tokens long, output_tokens long, cache_read_input_tokens long, cache_creation struct<ephemeral_5m_input_tokens long, ephemeral_1h_input_tokens long>, amount string>>")
    from tracewell.operators import reports

    got = {r["model"]: (round(r["list_usd"], 6), r["billed_usd"]) for r in reports.billed_usage(day).collect()}
    assert got == {"opus-x": (46.75, 12.34), "other": (0.0, 0.0)}


def test_asks_are_timed(spark):
    """An ask begins with the last operator text that has a time; without one, with the session's first time."""
    at = lambda sec: None if sec is None else f"2026-01-01T00:00:{sec:02d}Z"
    say = lambda k, stop="end_turn": json.dumps({"id": f"m{k}", "model": "x-1", "stop_reason": stop, "content": "ok", "usage": {"input_tokens": 1, "cache_creation": {"ephemeral_5m_input_tokens": k, "ephemeral_1h_input_tokens": 10 * k}}})
    user = lambda text: json.dumps({"role": "user", "content": text})
    rows = [
        ("s", 0, "summary", at(1), False, "{}"), ("s", 1, "assistant", at(4), False, say(1)), ("s", 2, "user", at(10), False, user("go")), ("s", 3, "assistant", at(12), False, say(2, "tool_use")),
        ("s", 4, "user", at(13), False, user([{"type": "tool_result", "tool_use_id": "?", "content": [{"type": "image", "x": 1}]}])), ("s", 5, "assistant", at(15), False, say(3)), ("s", 6, "user", None, False, user([{"type": "text", "text": ""}, {"type": "text", "text": "more"}])),
        ("s", 7, "assistant", at(20), False, say(4, "max_tokens")), ("s", 8, "assistant", None, False, say(5)), ("s", 9, "system", at(59), False, "{}"), ("u", 0, "user", at(1), False, user("nobody answers")),
    ]
    df = spark.createDataFrame(rows, "session_id string, pos long, type string, timestamp string, isMeta boolean, message string")
    out = transcripts.normalised(df).persist()
    assert [(r["elapsed_ms"], r["turn_count"], r["stop_reason"]) for r in out.where("kind = 'done'").orderBy("id").collect()] == [(3000, 1, "end_turn"), (5000, 2, "end_turn"), (10000, 1, "max_tokens"), (None, 2, "end_turn")]
    t = out.where("kind = 'task_telemetry'").collect()
    assert [(r["session_id"], r["wall_clock_ms"], r["cache_write_5m_tokens"], r["cache_write_1h_tokens"], r["provider_kind"], r["task_id"]) for r in t] == [("s", 58_000, 15, 150, "claude_code", "cc-s")]
    assert [(r["name"], r["content"]) for r in out.where("kind = 'tool_result'").collect()] == [("unknown", '{"type":"image","x":1}')]
    assert out.where("kind = 'user_message'").count() == 2


def test_transcripts_are_read_from_files(spark, tmp_path):
    """The path tells the provider, lines keep their numbers, broken lines are left out."""
    for folder, name in ((".claude-openrouter/projects/p", "a"), ("work/projects/p", "b")):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / f"{name}.jsonl").write_text('\nnot json\n{"type": "user", "timestamp": "2026-01-01T00:00:01Z", "message": {"role": "user", "content": "hi"}}\n{"broken\n{"type": "assistant", "message": {"id": "m", "model": "x-1", "content": "yes"}}\n')
    records = transcripts.read_records(spark, f"{tmp_path}/*/projects", recursiveFileLookup=True, pathGlobFilter="*.jsonl")
    assert sorted((r["session_id"], r["pos"], r["type"], r["provider"]) for r in records.collect()) == [("a", 2, "user", "openrouter"), ("a", 4, "assistant", "openrouter"), ("b", 2, "user", "claude_code"), ("b", 4, "assistant", "claude_code")]
    made = transcripts.normalised(records).where("kind = 'session_created'").collect()
    assert sorted((r["session_id"], r["provider_kind"], r["model"]) for r in made) == [("a", "openrouter", "x-1"), ("b", "claude_code", "x-1")]


def test_thinking_is_shown_as_such(spark):
    from pyspark.sql import functions as F

    content = json.dumps([{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "A"}, {"type": "text", "text": ""}, {"type": "image"}, {"type": "thinking"}])
    assert [r[0] for r in spark.createDataFrame([(content,), ("plain",), (None,)], "c string").select(transcripts.shown(F.col("c"))).collect()] == ["(thinking) hm\nA", "plain", ""]


@needs_data
def test_conversations_share_transcript_files(spark, tmp_path):
    """As many sessions as before, in far fewer files."""
    from tracewell.plans import source_queries
    from tracewell.plans.registry import Tables

    t = Tables(spark, SF_DIR)
    files = spark.read.text(source_queries._raw(t), wholetext=True, recursiveFileLookup=True).count()
    conversations = t.table("conversations").select("conv_id").distinct().count()
    assert files < conversations / 2
    assert source_queries._normalised(t).select("session_id").distinct().count() == t.table("conversations").where("role = 'assistant'").select("conv_id").distinct().count()
