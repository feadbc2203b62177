"""op11 to op13 against plain Python over hard inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from tracewell.llm import fill_middle, source_divergence, superkmers

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, row string"


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None if k % 7 == 0 else "ab"[k % 2], None if k % 5 == 0 else f"s{k % 3}", "mine") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA).repartition(3)


def sample_texts(seed, n=60, vocabulary=9):
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(45)]
    out = [None, "", " \n\t ", "one", " ".join(passage), "x y " * 300, "é" * 9 + "   z " * 30]
    for _ in range(n):
        words = [r.choice("abcdefghijklmnopq"[:vocabulary]) for _ in range(r.randrange(0, 90))]
        if r.random() < 0.5:
            at = r.randrange(len(words) + 1)
            words[at:at] = passage[r.randrange(10) : 20 + r.randrange(26)]
        out.append(r.choice((" ", "\n", "  \t")).join(words))
    return out + out[4:20]


def plain_dedup(rows):
    """rows: (order key, text). Windows are judged by (key, start)."""
    words = [WORD.findall((t or "").encode()) for _, t in rows]
    least = {}
    for (key, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            least[g] = min(least.get(g, (key, i)), (key, i))
    out = []
    for (key, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - 19) if least[tuple(w[i : i + 20])] < (key, i) for j in range(i, i + 20)}
        out.append((key[1], len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("hot", [4096, 16])
def test_super_kmers(spark, monkeypatch, hot):
    monkeypatch.setattr(superkmers, "HOT", hot)
    monkeypatch.setattr(superkmers, "SAMPLE", 1)
    monkeypatch.setattr(superkmers, "PART_BYTES", 4000)
    texts = sample_texts(1)
    docs = table(spark, texts)
    assert (len(superkmers.hot_buckets(docs.select(*superkmers._key(docs, "doc_id", "text")))) > 0) == (hot == 16)
    assert found(superkmers.report(docs)) == plain_dedup([((False, i), t) for i, t in enumerate(texts)])


@pytest.mark.parametrize("block", [150, 300, 1 << 20])
def test_first_windows_of_texts_in_pieces(monkeypatch, block):
    """What tasks do, here in one process (a worker wouldn't see the small sizes): long texts in pieces, blobs, parts."""
    monkeypatch.setattr(superkmers, "BLOCK", block)
    monkeypatch.setattr(superkmers, "BLOB_BYTES", 2 * block)
    texts = sample_texts(4)
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array([False] * n), pa.array(range(n)), pa.array([0] * n), pa.array([t and t.encode() for t in texts], pa.binary())], names=["late", "doc_id", "tie", "words"])
    hot = np.unique(np.concatenate([superkmers.SuperKmers(b).bucket for b in superkmers._blocks([t and t.encode() for t in texts])]))[::3]
    blobs = pa.Table.from_batches(superkmers._parts(3, hot)(iter([batch])))
    got = set()
    for part in range(3):
        mine = blobs.filter(pa.compute.equal(blobs["part"], part))
        for r in superkmers._firsts_of_part(mine).to_pylist() if mine.num_rows else ():
            got |= {(r["doc_id"], r["start"] + i) for i in range(15) if r["bits"] >> i & 1}
    least = {}
    for out in superkmers._hot_windows(hot)(iter([batch])):
        for r in out.to_pylist():
            least[r["window"]] = min(least.get(r["window"], (r["doc_id"], r["start"])), (r["doc_id"], r["start"]))
    assert least and not got & set(least.values())
    expected = {}
    for d, t in enumerate(texts):
        w = WORD.findall((t or "").encode())
        for i in range(len(w) - 19):
            expected.setdefault(tuple(w[i : i + 20]), (d, i))
    assert got | set(least.values()) == set(expected.values())


def test_super_kmers_with_null_and_repeated_ids(spark):
    """Rows of one id come in some order of their own; equal rows lose nothing to each other; null ids come last."""
    texts, r = sample_texts(2), random.Random(3)
    ids = [r.choice((None, 1, 2, 3, 4, 5)) for _ in texts]
    texts, ids = texts + texts[:30], ids + ids[:30]
    docs = table(spark, texts, ids)
    ties = {row["text"]: row["tie"] for row in docs.select("text", F.xxhash64(F.col("text").cast("binary")).alias("tie")).collect()}
    rows = [((i is None, i, ties[t]) if i is not None else (True, None, ties[t]), t) for i, t in zip(ids, texts, strict=True)]
    numbered = [((k[0], k[1] if k[1] is not None else 0, k[2]), t) for k, t in rows]
    expected = plain_dedup(numbered)
    got = [(r[0] if r[0] is not None else 0, *r[1:]) for r in superkmers.report(docs).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_super_kmers_carry_columns(spark):
    docs = table(spark, ["a b"]).withColumnRenamed("lang", "kept")
    assert superkmers.deduplicated(docs).select("row.*", "n_removed").collect()[0].asDict() == {"doc_id": 0, "text": "a b", "kept": None, "source": None, "row": "mine", "n_removed": 0}


def test_least_places_are_leftmost():
    r = np.random.default_rng(1)
    for span in range(1, 20):
        h = r.integers(0, 5, 60).astype(np.uint64)
        assert superkmers._least_places(h, span).tolist() == [i + int(np.argmin(h[i : i + span])) for i in range(61 - span)]


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    head, mid, tail = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    spm = h[3] % 100 < 50
    out = f"<S>{tail}<P>{head}<M>{mid}" if spm else f"<P>{head}<S>{tail}<M>{mid}"
    return doc_id, n, "spm" if spm else "psm", len(head), len(mid), sha(out), sha(text)


FIM_TEXTS = [None, "", "\n", "\n\n\n", "a", "a\n", "é\n漢字\r\n\n😀", "has <S> in it\nb", "< P>\n<", "x\n" * 200] + [f"{'line é ' * k}\n" * (k % 9) + "end" * (k % 2) for k in range(60)]


def test_fill_middle(spark):
    ids = list(range(len(FIM_TEXTS) - 1)) + [None]
    assert found(fill_middle.report(table(spark, FIM_TEXTS, ids))) == sorted((plain_fim(i, t) for i, t in zip(ids, FIM_TEXTS, strict=True)), key=repr)


@pytest.mark.parametrize("size", [1, 2, 7, 64])
def test_small_frames(size):
    """Frames of few bytes put characters, marks and lines across frames."""
    for text in FIM_TEXTS:
        raw = (text or "").encode()
        units = re.findall(rb"[^\n]*\n|[^\n]+", raw)
        w = fill_middle.written([raw[:3], raw[3:]], size)
        assert (w.units, w.chars, w.bytes) == (len(units), len(text or ""), len(raw))
        reader = fill_middle.FrameReader(w.frames)
        assert b"".join(reader.stream(0)) == raw and reader.size() == len(raw)
        for k in range(len(units)):
            assert reader.after_unit(k) == (len(b"".join(units[:k])), len(b"".join(units[:k]).decode()))
        for form in ("psm", "spm") if b"<S>" not in raw else ():
            cuts = [len(b"".join(units[: len(units) // 3])), len(b"".join(units[: len(units) // 2]))]
            out = fill_middle.written(fill_middle.pieces(w.frames, form, cuts), size).frames
            assert b"".join(fill_middle.restored(out, form)) == raw


def test_fill_middle_outputs_are_texts(spark):
    docs = table(spark, ["a\nb\nc\nd\n" * 50, "e"]).withColumnRenamed("row", "output")
    rows = {r["doc_id"]: r for r in fill_middle.fill_in_middle(docs).collect()}
    assert {fill_middle.text_of(r["output"])[:3] for r in rows.values()} <= {"<P>", "<S>"}
    assert "".join(p.decode() for p in fill_middle.restored(rows[0]["output"], rows[0]["form"])) == "a\nb\nc\nd\n" * 50
    plain = fill_middle.fill_in_middle(docs, rate=0).collect()
    assert {r["form"] for r in plain} == {"plain"} and {fill_middle.text_of(r["output"]) for r in plain} == {"a\nb\nc\nd\n" * 50, "e"}


def test_a_cut_opens_one_frame():
    text = b"".join(b"%d\n" % i for i in range(50_000))
    frames = fill_middle.written([text], 1000).frames
    reader, opened = fill_middle.FrameReader(frames), []
    real = reader.frame
    reader.frame = lambda i: opened.append(i) or real(i)
    at, chars = reader.after_unit(31_415)
    assert (text[:at], chars) == (b"".join(b"%d\n" % i for i in range(31_415)), at) and len(set(opened)) == 1


def plain_divergence(rows, least=10):
    term = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = Counter(t.translate(lower) for t in term.findall((text or "").encode()))
        df[lang].update(found.keys())
        counts[lang, source].update(found)
        groups.add((lang, source))
    kept = {lang: sorted(t for t, k in d.items() if k >= least) for lang, d in df.items()}
    whole = defaultdict(Counter)
    for (lang, _), c in counts.items():
        whole[lang].update(c)
    f = lambda p, q: (p - q) ** 2 // (p + q)

    def shares(c, lang):
        ks = kept[lang]
        size = sum(c[t] for t in ks)
        return {t: 1 + 10**9 * (c[t] + 2) // (size + 2 * len(ks)) for t in ks}

    out = []
    for lang, source in groups:
        p, q = shares(counts[lang, source], lang), shares(whole[lang], lang)
        pairs = [(-sum(f(p[t], r[t]) for t in p), s.encode()) for g, s in groups if g == lang and s != source for r in [shares(counts[lang, s], lang)]]
        terms = [(-f(p[t], q[t]), t) for t in p if counts[lang, source][t] and p[t] > q[t]]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
            out += [(lang, source, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(items)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [10, 1, 1000])
def test_source_divergence(spark, monkeypatch, least):
    monkeypatch.setattr(source_divergence, "LEAST_DOCS", least)
    texts = sample_texts(5, 80) + ["Straße ÉTÉ\u0085x y it's A1b2", "é" * 50 + " Z" * 5000]
    docs = table(spark, texts)
    rows = [(r["text"], r["lang"], r["source"]) for r in docs.collect()]
    assert found(source_divergence.report(docs)) == plain_divergence(rows, least)


def test_sums_in_pieces(monkeypatch):
    """What tasks do, in one process: partial sums sent early, terms in small blocks."""
    texts = [(t or "").encode() for t in sample_texts(6)]
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * len(texts)), pa.array([f"s{i % 3}" for i in range(len(texts))]), pa.array(texts, pa.binary())], names=["lang", "source", "text"])
    p = np.random.default_rng(1).integers(1, 10**9, (50, 4))
    vectors = pa.RecordBatch.from_arrays([pa.array(["a", "b"] * 25), pa.array(p.tolist())], names=["lang", "p"])

    def sums():
        total = Counter()
        for out in source_divergence._counted(iter([batch])):
            for r in out.to_pylist():
                total[r["source"], r["term"], "n"] += r["n"]
                total[r["source"], r["term"], "docs"] += r["docs"]
        pairs = {(r["lang"], r["a"], r["b"]): r["value"] for out in source_divergence._pair_sums(iter([vectors])) for r in out.to_pylist()}
        return total, pairs

    whole = sums()
    monkeypatch.setattr(source_divergence, "HELD", 5)
    monkeypatch.setattr(source_divergence, "BLOCK", 9)
    assert sums() == whole
    assert whole[1]["a", 1, 3] == sum(int(x - y) ** 2 // int(x + y) for x, y in p[::2, [1, 3]])


def test_counts_beyond_64_bits_stay_exact(spark):
    df = spark.createDataFrame([(2_000_000_000_000, 9_000_000_000_000, 50_000)], "n long, size long, v long")
    got = df.select(source_divergence.share(df["n"], df["size"], df["v"])).first()[0]
    assert got == 1 + 10**9 * 2_000_000_000_002 // (9_000_000_000_000 + 100_000)


@pytest.mark.parametrize("report", [superkmers.report, fill_middle.report, source_divergence.report])
def test_empty_tables(spark, report):
    assert report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pages_without_boxes_or_names():
    """Pages that the templates don't make: bare paragraphs, no tags at all, boxes of unseen names, readers' responses."""
    from tracewell.llm import html_text

    field = html_text.train(html_text.labelled_pages())
    pages = {
        "<p>Just a paragraph.</p><p>And one more.</p>": "Just a paragraph.\nAnd one more.",
        "Just some text without a tag at all.": "Just some text without a tag at all.",
        '<div class="wrapper"><div class="bar"><a href=/l>Login</a> <a href=/r>Register</a></div><h1>Title here</h1><p>The first paragraph of the article is long enough to read.</p><p>Second one follows it.</p><div>All rights reserved 2020</div></div>': "Title here\nThe first paragraph of the article is long enough to read.\nSecond one follows it.",
        '<article><h1>T</h1><p>Body text of the article, some words.</p></article><section class="responses"><p>Nice post, thank you</p></section>': "T\nBody text of the article, some words.",
        None: "",
        "<nav><a href=x>Home</a></nav>": "",
    }
    assert {h: html_text.main_text(h, field) for h in pages} == pages
