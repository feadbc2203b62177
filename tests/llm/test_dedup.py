"""Near duplicates, repeated passages and benchmark passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from tracewell.llm import decontaminate, grouping_sort, simhash, suffix_dedup
from tracewell.llm.components import components

LINE = "The quick brown fox jumps over the lazy dog and then some more words follow here. "
MIX = "x".join(map(str, range(60)))
ROWS = [
    (1, MIX + "é" * 3 + LINE), (2, None), (3, ""), (4, LINE * 3), (5, "a" * 300), (6, "a" * 120), (7, MIX), (7, "zz" + LINE), (7, LINE + "yy"), (None, LINE), (None, LINE + MIX), (9, "b" * 49), (10, "b" * 49),
    (11, MIX[:60] + LINE[10:70]), (12, "ü" * 100), (13, "ü" * 30 + "q" + "ü" * 40), (1, MIX + "é" * 3 + LINE), (14, LINE[:49]), (15, "   " + LINE[:51]), (16, " is" * 200), (17, " is" * 90),
]


def removed(rows):
    seen = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - 49):
            s = raw[i : i + 50]
            seen[s] = min(seen.get(s, 2**63), d if d is not None else 2**63 - 1)
    out = []
    for d, t in rows:
        raw, o = (t or "").encode(), d if d is not None else 2**63 - 1
        hit = [False] * len(raw)
        for i in range(len(raw) - 49):
            if seen[raw[i : i + 50]] < o:
                hit[i : i + 50] = [True] * 50
        runs = sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit))
        out.append((d, len(raw), sum(hit), runs, hashlib.sha256(bytes(b for b, h in zip(raw, hit, strict=True) if not h)).hexdigest()))
    return sorted(out, key=str)


def measured(df):
    return sorted(((r["row"]["doc_id"], r["n_bytes"], sum(x["stop"] - x["start"] for x in r["removed"]), len(r["removed"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffix_dedup.removals(df).collect()), key=str)


def test_suffix_dedup_equals_brute_force(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, kind string, bucket int")  # clashing names
    assert measured(df) == removed(ROWS)
    assert suffix_dedup.deduplicated(df).columns == df.columns
    assert suffix_dedup.removals(df.limit(0)).count() == 0


def test_suffix_dedup_tells_rows_with_one_id_apart(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [text(70) for _ in range(40)]
    rows = [(1, " ".join(shared)), (2, shared[0]), (2, shared[0]), (2, shared[0])]
    for i in range(1200):
        rows.append((5 if i % 2 else None, text(rng.randint(0, 90)) + (rng.choice(shared) if i % 3 else "") + text(20)))
    assert measured(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == removed(rows)


def test_stretches_of_very_many_rows_are_merged():
    row = np.repeat(np.arange(1 << 22), 2)
    got = suffix_dedup.merged(row, np.tile([10, 50], 1 << 22), np.full(len(row), 50))
    assert (got[0] == np.arange(1 << 22)).all() and (got[1] == 10).all() and (got[2] == 90).all()


def test_hot_anchors_lose_nothing(spark):
    """A passage that most documents quote, dealt out by windows."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(90)
    rows = [(i, text(rng.randint(0, 60)) + passage[rng.choice([0, 0, 15]) :] + text(30)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    own = df.selectExpr("doc_id AS number", "text")
    assert len(suffix_dedup.hot_anchors(own, 1, 20)) > 0 and len(suffix_dedup.hot_anchors(own, 1, 10**6)) == 0
    out = suffix_dedup.removals(df, sampled=1, hot=20)
    got = sorted(((r["row"]["doc_id"], r["n_bytes"], sum(x["stop"] - x["start"] for x in r["removed"]), len(r["removed"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in out.collect()), key=str)
    assert got == removed(rows)


def test_nothing_is_removed_but_by_suffix_arrays(spark, monkeypatch):
    """Equal contexts are told apart from others by bytes, and covered by what the suffix arrays say."""
    rng = random.Random(12)
    texts = [bytes(rng.choice(b"ab") for _ in range(100)) for _ in range(5)] * 3
    data, size = np.frombuffer(b"".join(texts), np.uint8), np.full(15, 100)
    stop = np.cumsum(size)
    doc, mid, gram, context, left, right = suffix_dedup.anchors(data, stop - size, stop)
    row, before, runs = suffix_dedup.covered(data, mid, left, right, doc, gram)
    whole = runs == left[row] + right[row] - suffix_dedup.SIDE + 1
    assert set(doc[row[whole]]) == set(range(5, 15))
    # Every hash the same: bytes decide alone.
    monkeypatch.setattr(suffix_dedup, "_context_hash", lambda hashes, mid, left, right: np.zeros(len(mid), np.uint64))
    same = suffix_dedup.covered(data, mid, left, right, doc, np.zeros(len(mid), np.uint64))
    key = lambda x: sorted(zip(*map(list, x), strict=True))
    assert {r for r, *_ in key(same)} >= {r for r, *_ in key((row, before, runs))}
    monkeypatch.undo()
    monkeypatch.setattr(suffix_dedup, "least_documents", lambda data, start, stop, who, group: [np.empty(0, np.int64)] * 3)
    assert len(suffix_dedup.covered(data, mid, left, right, doc, gram)[0]) == 0


def test_contexts_are_split_without_loss():
    """The comparing step with groups of any size, against brute force over windows."""
    rng = random.Random(5)
    side, n = suffix_dedup.SIDE, 60
    anchor = bytes(rng.choice(b"abc") for _ in range(suffix_dedup.GRAM))
    pick = lambda: bytes(rng.choice(b"ab") if rng.random() < 0.1 else 97 for _ in range(rng.choice([side, side, 20])))
    texts = [(pick(), pick()) for _ in range(n)]
    who = np.array([rng.randrange(20) for _ in range(n)])
    data = np.frombuffer(b"".join(a + anchor + b for a, b in texts), np.uint8)
    left, right = np.array([len(a) for a, _ in texts]), np.array([len(b) for _, b in texts])
    mid = np.cumsum(left + suffix_dedup.GRAM + right) - suffix_dedup.GRAM - right
    window = lambda i, j: bytes(data[mid[i] - j : mid[i] - j + 50]) if side - right[i] <= j <= left[i] else None
    least = {}
    for i in range(n):
        for j in range(side + 1):
            if w := window(i, j):
                least[j, w] = min(least.get((j, w), 99), who[i])
    expected = {(i, j) for i in range(n) for j in range(side + 1) if (w := window(i, j)) and least[j, w] < who[i]}
    for many in (1, 2, 5, 1000):
        got = {(int(r), int(b - k)) for r, b, m in zip(*suffix_dedup.covered(data, mid, left, right, who, np.zeros(n, np.uint64), many), strict=True) for k in range(m)}
        # A string that holds the anchor twice may stand at two places of it: an array of several contexts finds it at both.
        anywhere = {(i, j) for i in range(n) for j in range(side + 1) if (w := window(i, j)) and min((v for (_, x), v in least.items() if x == w)) < who[i]}
        assert expected <= got <= anywhere


@pytest.mark.parametrize("letters", [2, 3, 5])
def test_linear_grouping_sorts_suffixes(letters):
    rng = np.random.default_rng(letters)
    for _ in range(40):
        texts = [np.r_[rng.integers(1, letters + 1, rng.integers(0, 40)), 0] for _ in range(rng.integers(1, 8))] + [np.r_[np.tile([1, 2], 9), 0]]
        got, at = grouping_sort.suffix_arrays(np.concatenate(texts), np.array([len(t) for t in texts])), 0
        for t in texts:
            assert (got[at : at + len(t)] - at).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
            at += len(t)


def prints(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")))
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark):
    rng = random.Random(1)
    words = ["w%d" % i for i in range(500)]
    base = [[rng.choice(words) for _ in range(80)] for _ in range(12)]
    rows = [(2, None), (3, ""), (4, " \n"), (5, "One two"), (6, "one  TWO"), (None, "one two"), (7, "É é É é É")]
    for i in range(150):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((100 + i, " ".join(t)))
    rows += [rows[10], (999, rows[12][1])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fingerprint int")
    fp = [prints(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    expected = sorted(((d, fp[i], least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)
    got = sorted(((r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in simhash.grouped(df).collect()), key=str)
    assert got == expected
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(set(least.values()))
    assert simhash.grouped(df.limit(0)).count() == 0


def test_pipeline_takes_out_near_copies_of_five_word_shingles(spark):
    import corpus_pipeline

    rng = random.Random(7)
    words = ["w%d" % i for i in range(900)]
    rows, sets = [(1, None), (2, ""), (3, "one two"), (4, "One  TWO"), (None, "one two")], {}
    for family in range(12):
        base = [rng.choice(words) for _ in range(150)]
        for copy in range(6):
            t = list(base)
            for k in rng.sample(range(150), 0 if not copy else rng.choice([1, 2, 3, 6])):
                t[k] = rng.choice(words)
            rows.append((100 + family * 10 + copy, " ".join(t)))
    for d, t in rows[5:]:
        w = t.split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    root = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[d]] == root[d] for d in sets):
            break
    far = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and (prints(dict(rows)[a]) ^ prints(dict(rows)[b])).bit_count() > 4]
    assert far  # op2's measure doesn't link these
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r["doc_id"] for r in corpus_pipeline.near_duplicates_out(spark, df, "").collect()]
    assert sorted(kept, key=str) == sorted([1, 3, None, *set(root.values())], key=str)


def test_every_near_pair_is_a_link(spark):
    rng = random.Random(4)
    fps = sorted({x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for x in [rng.getrandbits(64) for _ in range(40)] for _ in range(8)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, id long")
    got = {(r["a"], r["b"]) for r in simhash.links(df).collect()}
    assert got == {(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 4}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 55), (70, 70)]
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {55: 50, 60: 50}


def hits(docs, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
    out = []
    for d, t in docs:
        w, hit, found = cut(t), set(), set()
        for item, s in items:
            x = cut(s)
            n = min(window, len(x))
            for i in range(len(x) - n + 1 if n else 0):
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == x[i : i + n]:
                        hit.update(range(k, k + n))
                        found |= {str(item)} - {"None"}
        out.append((d, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out, key=str)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(2)
    words = ["alpha", "Beta", "gämma", "d4", "e", "zeta"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = [text(30) for _ in range(6)]
    items = [(i, t) for i, t in enumerate(long)] + [(10, None), (11, ""), (12, "unique-short item"), (None, "null id item here"), (9, long[0]), (2, "- , .")]
    docs = [(i, text(rng.randint(0, 12)) + ", " + rng.choice(long)[rng.randint(0, 40) :] + "\n" + text(5)) for i in range(30)]
    docs += [(100, None), (101, ""), (102, "a unique short item, twice: Unique SHORT item"), (103, "NULL id item here"), (104, long[0]), (104, long[0]), (None, long[1])]
    df, bench = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_words int"), spark.createDataFrame(items, "item_id long, text string")
    for part_words in (500_000, 40):
        got = decontaminate.matches(df, bench, part_words=part_words).collect()
        assert sorted(((r["row"]["doc_id"], r["n_words"], sum(s["length"] for s in r["spans"]), ",".join(r["items"])) for r in got), key=str) == hits(docs, items)
    assert decontaminate.decontaminated(df, bench).columns == df.columns
    assert decontaminate.decontaminated(df, bench.limit(0)).count() == len(docs)
    assert decontaminate.matches(df.limit(0), bench).count() == 0


def test_bytes_are_compared_in_steps(monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    a, b, size = rng.integers(0, 3900, 1000), rng.integers(0, 3900, 1000), rng.integers(1, 8, 1000)
    expected = [bytes(data[x : x + n]) == bytes(data[y : y + n]) for x, y, n in zip(a, b, size, strict=True)]
    assert any(expected) and not all(expected)
    for rows in (1, 7, 1 << 15):
        monkeypatch.setattr(suffix_dedup, "CHUNK_ROWS", rows)
        assert suffix_dedup._alike(data, a, b, size).tolist() == expected


def test_groups_stay_whole(monkeypatch):
    group, size = np.repeat(np.arange(50), np.arange(50)), np.full(1225, 10)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 300)
    parts = list(suffix_dedup._by_groups(group, size))
    assert np.concatenate(parts).tolist() == list(range(1225)) and len(parts) > 10
    seen = [set(group[p]) for p in parts]
    assert sum(map(len, seen)) == len(set().union(*seen))
    assert list(suffix_dedup._by_groups(group[:0], size[:0])) == []


def test_pipeline_links_near_copies_by_fingerprints_too(spark, monkeypatch):
    """Without any bucket the fingerprints still find near copies, and pairs that are near by bits alone are no links."""
    from tracewell.llm import near_copies

    monkeypatch.setattr(near_copies, "links", lambda members, sets: sets.selectExpr("id AS u", "id AS v").limit(0))
    base = [f"w{i}" for i in range(400)]
    texts = {1: base, 2: [*base[:399], "x"], 3: [f"v{i}" for i in range(400)]}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_copies.grouped(df).collect()} == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("block", [1 << 16, 300])
def test_pipeline_loses_no_near_copy_of_a_large_bucket(spark, monkeypatch, block):
    """One bucket of 100 texts, of which each two are near copies and all others half alike, and one whose nodes link in a chain."""
    from tracewell.llm import near_copies

    monkeypatch.setattr(near_copies, "BLOCK", block, raising=False)
    sets = {2 * i + j: [*range(50), *range(100 + 60 * i, 148 + 60 * i), 10_000 + j] for i in range(50) for j in range(2)}
    sets |= {200 + i: list(range(20_000 + 10 * i, 20_100 + 10 * i)) for i in range(40)}
    members = [(7, k, 100) if k < 200 else (8, k, 40) for k in sets]
    found = near_copies.links(spark.createDataFrame(members, "bucket long, id long, n long"), spark.createDataFrame(list(sets.items()), "id long, hashes array<int>"))
    met = [(r["u"], r["v"]) for r in components(found).collect()]
    assert sorted(met) == sorted([(2 * i + 1, 2 * i) for i in range(50)] + [(200 + i, 200) for i in range(1, 40)])


def test_suffix_dedup_sends_less_than_it_reads(spark):
    """Texts are compressed before they are dealt out, and come back as they were; an anchor takes few bytes."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    texts = [None, "", "é" * 10, *(" ".join(rng.choice(words) for _ in range(2000)) for _ in range(60))]
    own = spark.createDataFrame(list(enumerate(texts)), "number long, text string").repartition(3)
    raw = [(t or "").encode() for t in texts]
    dealt = suffix_dedup._with_bucket(own, 12).toArrow()
    assert sum(len(t.as_py() or b"") for t in dealt.column("text")) < 0.6 * sum(map(len, raw))
    assert dict(zip(dealt.column("number").to_pylist(), suffix_dedup._texts(dealt), strict=True)) == dict(enumerate(raw))

    class Hot:
        value = np.empty(0, np.uint64)

    blobs = list(suffix_dedup._send_anchors(12, 12, Hot)(iter(own.selectExpr("number ord", "number", "text").toArrow().to_batches())))
    sent = sum(len(x.as_py()) for b in blobs if b.num_rows and b.column("kind")[0].as_py() == suffix_dedup.ANCHOR for x in b.column("blob"))
    stop = np.cumsum([len(t) for t in raw])
    assert 0 < sent < 8.5 * len(suffix_dedup.anchors(np.frombuffer(b"".join(raw), np.uint8), stop - np.diff(np.r_[0, stop]), stop)[0])


def test_contexts_of_anchors_with_equal_numbers_are_told_apart():
    """Anchors that meet by the short hashes that are sent, as if they were one: only equal bytes count."""
    a, b, c = (bytes(random.Random(i).choices(range(97, 123), k=76)) for i in range(3))
    data, mid, side = np.frombuffer(a + b + c + a, np.uint8), np.arange(4) * 76 + 26, np.full(4, 26)
    row, before, runs = suffix_dedup.covered(data, mid, side, side, np.array([5, 6, 7, 8]), np.zeros(4, np.int64))
    assert [row.tolist(), before.tolist(), runs.tolist()] == [[3], [26], [27]]
