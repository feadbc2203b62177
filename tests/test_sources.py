"""Discovery, files and shapes on small trees."""

import os

import pytest
from pyspark.sql import functions as F
from tracewell.operators import shapes
from tracewell.sources import artifacts, discovery


def put(path, text="x\n", mtime=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    if mtime:
        os.utime(path, (mtime, mtime))


def test_discovery(spark, tmp_path):
    """Machines, the older layout, subagents, benches, histories, hidden folders, copies."""
    for name in ("m1/events/d1/s1.jsonl", "m1/events/d2/s1.jsonl", "m2/events/d1/s9.jsonl", "m2/events/d1/s9.txt", "m2/other/d1/no.jsonl"):
        put(tmp_path / "mu" / name)
    for name in ("old/events/d1/s1.jsonl", "old/telemetry.sqlite"):
        put(tmp_path / name)
    names = lambda df, root: sorted(r["path"].split(f"/{root}/")[-1] for r in df.collect())
    assert names(discovery.mu_logs(spark, f"{tmp_path}/mu"), "mu") == ["m1/events/d1/s1.jsonl", "m1/events/d2/s1.jsonl", "m2/events/d1/s9.jsonl"]
    assert names(discovery.mu_logs(spark, sink=f"{tmp_path}/old/telemetry.sqlite"), "old") == ["events/d1/s1.jsonl"]
    assert discovery.mu_logs(spark, f"{tmp_path}/nowhere").count() == 0 == discovery.cc_logs(spark, None).count()
    tree = {"claude/h1/projects/p/u1.jsonl": 100, "claude/h2/projects/p/q/u1.jsonl": 200, "claude/h1/projects/p/history.jsonl": 1, "claude/h1/projects/bench-x/u3.jsonl": 1, "claude/h1/projects/p/subagents/u4.jsonl": 1, "claude/h1/.claude-openrouter/projects/u5.jsonl": 300, "mu/h3/events/d/s.jsonl": 5}
    for name, t in tree.items():
        put(tmp_path / "all" / name, mtime=1_700_000_000 + t)
    roots = [f"{tmp_path}/all/claude/*/*/", f"{tmp_path}/all/claude/h1/projects"]
    found = discovery.transcripts(spark, roots)
    assert names(found, "all") == ["claude/h1/.claude-openrouter/projects/u5.jsonl", "claude/h1/projects/p/u1.jsonl", "claude/h2/projects/p/q/u1.jsonl"]
    assert names(discovery.transcripts(spark, roots, subagents=True, bench=True), "all") == sorted(n for n in tree if n.startswith("claude") and "history" not in n)
    got = {(r["session_ref"], r["path"].split("/all/")[-1], r["mtime"].timestamp()) for r in discovery.sessions_of(found).collect()}
    assert got == {("cc:u1", "claude/h2/projects/p/q/u1.jsonl", 1_700_000_200.0), ("cc:u5", "claude/h1/.claude-openrouter/projects/u5.jsonl", 1_700_000_300.0)}
    placed = discovery.with_layout(discovery.listed(spark, f"{tmp_path}/all").unionByName(spark.createDataFrame([(f"file:{tmp_path}/all/x.jsonl", None, 1)], discovery.LISTING)), f"{tmp_path}/all")
    assert {(r["plane"], r["host"]) for r in placed.collect()} == {("cc", "h1"), ("cc", "h2"), ("mu", "h3"), ("x.jsonl", "?")}


def test_manifest(spark, tmp_path):
    put(tmp_path / "m.txt", "# sessions\n\nmu:d:s\tgood one\n cc:u \n  # more\ncc:v\t\n")
    assert [tuple(r) for r in discovery.manifest(spark, f"{tmp_path}/m.txt").collect()] == [("mu:d:s", "good one"), ("cc:u", None), ("cc:v", None)]


def test_tables_with_tabs(spark, tmp_path):
    df = spark.createDataFrame([("a\tb\nc", 1, None), ('q"uote', None, ""), ("", 3, "\\x")], "t string, n long, u string").coalesce(1)
    artifacts.write_tsv(df, f"{tmp_path}/t")
    part = next(p for p in (tmp_path / "t").iterdir() if p.name.startswith("part-"))
    assert part.read_text().split("\n")[:2] == ["t\tn\tu", "a b c\t1\t"]
    assert [tuple(r) for r in artifacts.read_tsv(spark, f"{tmp_path}/t", "t string, n long, u string").collect()] == [("a b c", 1, None), ('q"uote', None, None), (None, 3, "\\x")]


def test_probe_artifact(spark, tmp_path):
    """What is read back is what was written, in a pinned shape, also where the file has other fields or lacks some."""
    inter = spark.createDataFrame([(f"s{i}", float(i % 7), float(i % 5), i) for i in range(40)], "session_ref string, obs double, pred double, n_user int")
    alone = spark.createDataFrame([("u1", 3.0), ("u2", -1.0)], "session_ref string, pred double")
    sessions = artifacts.probe_sessions(inter, alone)
    meta = spark.createDataFrame([(0.5, 1.25, 40, 2, [("cost", 0.75)])], artifacts.META)
    artifacts.write_probe(meta, sessions, f"{tmp_path}/p")
    m, s = artifacts.read_probe(spark, f"{tmp_path}/p")
    assert m.collect() == meta.collect() and sorted(map(str, s.collect())) == sorted(map(str, sessions.collect()))
    panels = [(r["panel"], r["rank"], r["resid"]) for r in artifacts.probe_panels(s).orderBy("panel", "rank").collect()]
    resid = sorted((i % 5 - i % 7 for i in range(40)), reverse=True)
    assert [x for p, _, x in panels if p == "unnoticed"] == resid[:12] and [x for p, _, x in panels if p == "task_frust"] == resid[::-1][:12]
    assert [r["session_ref"] for r in artifacts.probe_panels(s).where("panel = 'unattended'").orderBy("rank").collect()] == ["u2", "u1"]
    put(tmp_path / "q" / "sessions" / "x.json", '{"session_ref": "z", "later": 1}\n')
    put(tmp_path / "q" / "meta" / "x.json", "{}\n")
    assert artifacts.read_probe(spark, f"{tmp_path}/q")[1].select("session_ref", "pred").first()[:] == ("z", None)


def test_arguments_of_unknown_shape(spark):
    rows = ['{"file_path": "", "path": "a"}', '{"path": 0, "notebook_path": "n"}', "rm -rf x", '{"cmd": "ls"', '"just text"', "[1]", None, "{}", '{"command": "c", "cmd": "d"}', '{"file_path": {"x": 1}}', '{"path": false}', ""]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, a string")
    got = df.select(shapes.file_argument(F.col("a")).alias("f"), shapes.command_argument(F.col("a")).alias("c")).collect()
    assert [r["f"] for r in got] == ["a", "n", "rm -rf x", '{"cmd": "ls"', "", "", "", "", "", '{"x":1}', "", ""]
    assert [r["c"] for r in got] == ["", "", "rm -rf x", '{"cmd": "ls"', "", "", "", "", "c", "", "", ""]


def test_union_of_unlike_tables(spark):
    a = spark.createDataFrame([(1, "x", 1.5)], "n int, s string, only double")
    b = spark.createDataFrame([(2.5, 7)], "n double, s long")
    c = spark.createDataFrame([("t", True)], "s string, flag boolean")
    out = shapes.widened_union([a, b, c])
    assert dict(out.dtypes) == {"n": "double", "s": "string", "only": "double", "flag": "boolean"}
    assert [tuple(r) for r in out.collect()] == [(1.0, "x", 1.5, None), (2.5, "7", None, None), (None, "t", None, True)]
    assert dict(shapes.widened_union([a.select("n"), spark.createDataFrame([(1 << 40,)], "n long")]).dtypes) == {"n": "bigint"}


def test_test_sessions_by_their_creation_record(spark):
    ev = spark.createDataFrame([("mu", "a", 2, "session_created", "real"), ("mu", "a", 1, "session_created", "faux"), ("mu", "b", 1, "session_created", None), ("mu", "b", 2, "session_created", "faux"), ("mu", "c", 1, "user_message", None)], "fleet string, session string, id long, kind string, model string")
    assert {r["session"] for r in shapes.without_stamped(ev).collect()} == {"b", "c"}


@pytest.mark.parametrize("known", [True, False])
def test_incidents_meet_sessions_and_marks(spark, known):
    from tracewell.operators import reports

    files = spark.createDataFrame([("/n/incident-2026-01-02-slow.md", "# Slow\nmu:d1/s1 and mu:d9:s9, mu:d1:s1 again")], "path string, text string")
    sessions = spark.createDataFrame([("mu:d1:s1",)] if known else [], "session_ref string")
    marks = spark.createDataFrame([("mu:d1:s1", 2)], "session_ref string, rating int")
    got = shapes.incident_sessions(reports.incidents(files, {"incident": "issue"}), sessions, marks)
    assert sorted((r["session_ref"], r["known"], r["rating"]) for r in got.collect()) == [("mu:d1:s1", known, 2), ("mu:d9:s9", False, None)]
