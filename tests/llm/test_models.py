"""Classifiers, extraction, mixing, search and URLs on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import html_text, language_id, mixing, neighbours, quality, toxicity, url_filter
from tracewell.llm.common import bounded_sample

ODD = [(1, None), (2, ""), (3, "1234 !!"), (None, "some text here"), (5, "x" * 50_000), (6, "same"), (6, "same")]
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def labelled(spark):
    good, bad = "the house of the river and a tree in the garden ", "##### buy%%% now%%% cheap$$$ "
    rows = [(i, (bad if i % 3 == 0 else good) * (1 + i % 4) + f" w{i}", int(i % 3 != 0), int(i % 4 == 0)) for i in range(200)]
    rows = [(i, t + (" you idiot person" if x else ""), q, x) for i, t, q, x in rows]
    return spark.createDataFrame([*rows, (900, None, 1, 0), (901, "the house", None, None)], DOCS + ", quality int, toxic int")


def test_toxicity(spark, labelled):
    model = toxicity.fit(labelled.withColumn("label", F.col("toxic")))
    got = {(r["doc_id"], r["text"]): r["score"] for r in model(spark.createDataFrame([*ODD, (20, "YOU idiot person"), (21, "the river")], DOCS)).collect()}
    assert got[(20, "YOU idiot person")] > 0.5 > got[(21, "the river")]
    assert all(0 <= s <= 1 for s in got.values()) and got[(1, None)] == got[(2, "")] == got[(3, "1234 !!")]
    docs = spark.createDataFrame([*[(*r, 0.1) for r in ODD], (20, "YOU idiot person", 0.2)], DOCS + ", score double")
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(ODD)
    assert toxicity.scored(docs, model).count() == len(ODD) + 1 and toxicity.scored(docs.limit(0), model).count() == 0
    none = toxicity.fit(labelled.limit(0).withColumn("label", F.col("toxic")))
    assert {r["score"] for r in none(docs.select("doc_id", "text")).collect()} == {0.0}
    ones = toxicity.fit(labelled.where("toxic = 1").withColumn("label", F.col("toxic")))
    assert {r["score"] for r in ones(docs.select("doc_id", "text")).collect()} == {1.0}


def test_toxicity_learns_pairs(spark):
    """Two words that are harmless alone and toxic together: no additive model tells these apart."""
    texts = {"red house": 0, "red door": 1, "blue house": 1, "blue door": 0}
    rows = [(i, f"{t} w{i % 7}", y) for i, (t, y) in enumerate(list(texts.items()) * 60)]
    df = spark.createDataFrame(rows, DOCS + ", label int")
    model = toxicity.fit(df)
    got = {r["text"]: r["score"] for r in model(spark.createDataFrame([(1, t) for t in texts], DOCS)).collect()}
    assert all((got[t] > 0.5) == bool(y) for t, y in texts.items())


def test_toxicity_keeps_words_that_tell_in_company(spark):
    """An insult is toxic together with a group's name only, which is as common in clean texts."""
    rows = []
    for i in range(600):
        insult, group = i % 3 == 0, i % 2 == 0
        rows.append((i, f"w{i % 11} {'idiot' if insult else 'fellow'} {'martians' if group else 'people'}".replace("w", "abcdefghijk"[i % 11]), int(insult and group)))
    bins = toxicity.telling_bins(spark.createDataFrame(rows, DOCS + ", label int").select(toxicity.terms(F.col("text")).alias("terms"), "label"))
    words = spark.createDataFrame([(1, "idiot"), (2, "martians"), (3, "a")], DOCS).select("text", toxicity.terms(F.col("text"))[0].alias("b")).collect()
    assert {r["text"] for r in words if r["b"] in bins} == {"idiot", "martians"}


def test_sample_is_bounded_whatever_the_key(spark):
    df = spark.createDataFrame([(i if i % 3 else 7, str(i)) for i in range(3000)], DOCS)
    for most in (1, 100, 1500):
        assert bounded_sample(df, "doc_id", most).count() == most
    assert bounded_sample(df, "doc_id", 5000).count() == 3000 and bounded_sample(df.limit(0), "doc_id", 5).count() == 0


def test_ids_beside_null_ids_stay_whole(spark):
    docs = spark.createDataFrame([(9007199254740993, "the house"), (None, "the tree"), (3, None)], DOCS)
    model = {"good": None, "constant": 0.5}
    assert {r["doc_id"] for r in quality.score(docs, {"constant": 0.5}).collect()} == {9007199254740993, None, 3}
    assert {r["doc_id"] for r in language_id.predict(docs, {}).collect()} == {9007199254740993, None, 3}


def test_differences_are_of_whole_texts(spark):
    """The difference of a long text is that of compressing all its pieces."""
    import zstandard as zstd

    good, bad = b"the house of the river and a tree in the garden " * 20, b"##### buy%%% now%%% cheap$$$ " * 20
    text = "the house of the river " * 3000 + "buy%%% now%%% " * 3000
    got = quality.differences(spark.createDataFrame([(1, text)], DOCS), good, bad).first()["difference"]
    sizes = []
    for d in (good, bad):
        c = zstd.ZstdCompressor(level=quality.LEVEL, dict_data=zstd.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
        sizes.append(sum(len(c.compress(text.encode()[i : i + 1024])) for i in range(0, len(text), 1024)))
    assert got == (sizes[1] - sizes[0]) / len(text)


def test_quality(spark, labelled):
    model = quality.fit(labelled.withColumn("label", F.col("quality")))
    got = {(r["doc_id"]): r["score"] for r in quality.score(spark.createDataFrame([*ODD[:5], (20, "the garden of the house and the tree"), (21, "cheap$$$ now%%% buy%%% #####")], DOCS), model).collect()}
    assert got[20] > got[21] and all(0 <= s <= 1 for s in got.values()) and got[1] == got[2]
    assert quality.fit(labelled.limit(0).withColumn("label", F.col("quality"))) == {"constant": 0.5}
    assert quality.fit(labelled.where("quality = 1").withColumn("label", F.col("quality"))) == {"constant": 1.0}
    assert {r["score"] for r in quality.score(spark.createDataFrame(ODD, DOCS), {"constant": 0.5}).collect()} == {0.5}


def out_of_place(text, profiles, most):
    """Cavnar and Trenkle's distance, word by word."""
    from collections import Counter

    def profile(t):
        n = Counter()
        for w in "".join(c if c.isalpha() else " " for c in t.lower()).split():
            w = f" {w} "
            for k in (1, 2, 3):
                n.update(w[i : i + k] for i in range(len(w) - k + 1) if w[i : i + k].strip())
        return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:most]]

    own, best = profile(text), {}
    for lang, other in profiles.items():
        rank = {g: i for i, g in enumerate(profile(other))}
        best[lang] = sum(abs(rank[g] - i) if g in rank else most for i, g in enumerate(own))
    return best


def test_language(spark):
    texts = {"en": "the house and the tree of the river with this that ", "de": "der hund und die katze mit einem haus über grün ", "fr": "le chien et la maison avec une forêt où être "}
    rows = [(i * 3 + j, t * (1 + i % 3), lang) for i in range(12) for j, (lang, t) in enumerate(texts.items())]
    profiles = language_id.fit(spark.createDataFrame([*rows, (99, None, "en"), (98, "zzz", None)], DOCS + ", lang string"))
    assert sorted(profiles) == sorted(texts)
    asked = [*ODD, (20, "Das Haus und der Hund"), (21, "THE TREE!"), (22, "la forêt")]
    got = {(r["doc_id"]): (r["lang_pred"], r["score"]) for r in language_id.predict(spark.createDataFrame(asked, DOCS), profiles).collect()}
    assert (got[20][0], got[21][0], got[22][0]) == ("de", "en", "fr")
    assert got[1] == got[2] == got[3] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())
    distances = out_of_place("Das Haus und der Hund", {k: t * 12 for k, t in texts.items()}, language_id.PROFILE)
    assert min(distances, key=distances.get) == "de"
    assert language_id.fit(spark.createDataFrame([], DOCS + ", lang string")) == {}
    assert {r["lang_pred"] for r in language_id.predict(spark.createDataFrame(asked, DOCS), {}).collect()} == {"und"}


def test_gram_counts_match_slices():
    grams, counts = language_id.gram_counts("Ab, ab")
    want = {" a": 2, "ab": 2, "b ": 2, "a": 2, "b": 2, " ab": 2, "ab ": 2}
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    assert dict(zip(grams.tolist(), counts.tolist(), strict=True)) == {code(g): n for g, n in want.items()}


FIELD = None


def field():
    global FIELD
    FIELD = FIELD or html_text.train(html_text.labelled_pages())
    return FIELD


def test_html_blocks_and_text(spark):
    page = (
        '<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>Home</a></li><li><a>More</a></li></ul></nav>'
        '<div class="cookie-notice">We use cookies.</div><!-- <p>no</p> --><article><h1>A &amp; B</h1><p><b>One\n  two<br>three.<br><p>Caf&eacute; &#8212; next.</p><aside>See also this</aside><p>Last <i>wo</i>rds.</p></article>'
        '<section class="comments"><p>First! says a reader.</p></section><form><label>Name</label><input></form><footer>&copy; x</footer></body></html><cut'
    )
    df = spark.createDataFrame([(1, "u", page, "z"), (2, None, None, "z"), (3, "u", "", "z"), (None, "u", "<p></p>", "z"), (5, "u", page, "z"), (6, "u", "<p>" + "a " * 30_000, "z")], "page_id long, url string, html string, text string")
    got = {r["row"]["page_id"]: r["text"] for r in html_text.extracted(df, field()).collect()}
    assert got[1] == got[5] == "A & B\nOne two three.\nCafé — next.\nLast words."
    assert got[2] == got[3] == got[None] == ""
    assert html_text.extracted(df.limit(0), field()).count() == 0


def test_html_field_on_held_out_pages():
    pages = html_text.labelled_pages(150, seed=77)
    right = sum(a == b for h, y in pages for a, b in zip(field().label(html_text.blocks(h)), y, strict=True))
    assert right / sum(len(y) for _, y in pages) > 0.98


def test_viterbi_is_the_best_labelling():
    from itertools import product

    for h, _ in html_text.labelled_pages(20, seed=3):
        page = html_text.blocks(h)[:9]
        f = field()
        e = [f.weights[[f.index[x] for x in fs if x in f.index]].sum(axis=0) for fs in html_text.features(page)]
        score = lambda y: f.start[y[0]] + sum(e[i][v] for i, v in enumerate(y)) + sum(f.steps[a, b] for a, b in zip(y, y[1:], strict=False))  # noqa: B023, E731
        assert abs(score(f.label(page)) - max(map(score, product((0, 1), repeat=len(page))))) < 1e-9


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 50)), f"s{i % 5}" if i % 7 else None) for i in range(300)]
    rows += [(1000, None, "s0"), (1001, "", "only-empty"), (1002, "a b c", "tiny"), rows[5], rows[5], (None, "x y", "s1")]
    df = spark.createDataFrame([(*r, 9) for r in rows], DOCS + ", source string, size int")
    got = mixing.report(df, block_words=4, bin_blocks=16, shard_blocks=32).withColumn("h", F.hash("doc_id")).collect()
    sizes, want = {}, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, cap = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, {s: 2 * sizes[s] for s in order}
    left, open_ = 1.5 * sum(sizes.values()), list(order)
    while open_:  # reshare the excess, again and again
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) >= cap[s]]
        if not over:
            want |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        want |= {s: cap[s] for s in over}
        left, open_ = left - sum(cap[s] for s in over), [s for s in open_ if s not in over]
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    source = {(d, len((t or "").split())): s for d, t, s in rows}
    taken = {}
    for r in got:
        s = source[(r["doc_id"], r["size"])]
        assert abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == sizes[s]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in order)
    again = mixing.report(df.repartition(3), block_words=4, bin_blocks=16, shard_blocks=32)
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again.collect()))
    assert mixing.report(df.limit(0)).count() == 0
    assert {r["taken"] for r in mixing.report(df.where("text is null or text = ''")).collect()} == {0}


def test_hypergeometric_matches_its_distribution(spark):
    from math import comb

    total, good, drawn, n = 30, 12, 10, 20_000
    x = mixing.hypergeometric(F.lit(total), F.lit(good), F.lit(drawn), (F.col("id") + 0.5) / n)
    got = {r["x"]: r["count"] / n for r in spark.range(n).select(x.alias("x")).groupBy("x").count().collect()}
    for k in range(drawn + 1):
        assert abs(got.get(k, 0) - comb(good, k) * comb(total - good, drawn - k) / comb(total, drawn)) < 2 / n


def test_shard_quotas_keep_every_block(spark):
    quotas = spark.createDataFrame([(0, 1000), (1, 10), (2, 0), (3, 333)], "sidx long, quota long")
    rows = mixing.shard_quotas(quotas, 3).collect()
    per_source, per_shard = {}, {}
    for r in rows:
        per_source[r["sidx"]] = per_source.get(r["sidx"], 0) + r["quota"]
        per_shard[r["shard"]] = per_shard.get(r["shard"], 0) + r["quota"]
    assert per_source == {0: 1000, 1: 10, 2: 0, 3: 333} and len(per_shard) == 8
    assert max(per_shard.values()) - min(per_shard.values()) <= 1 and min(r["quota"] for r in rows) >= 0


def test_neighbours_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    odd = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [nan] * 16), (2004, [None] * 16), (2005, [inf] * 16), (2006, [1.0] * 3), (None, rows[0][1])]
    same = [(3000 + i, rows[50][1]) for i in range(9)] + [rows[50]]
    df = spark.createDataFrame([*rows, *odd, *same], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, df.where("vec_id % 50 = 0"), 5).collect()
    ids = np.array([i for i, _ in rows] + [3000 + i for i in range(9)])
    full = np.array([v for _, v in rows] + [rows[50][1]] * 9, float)
    full /= np.linalg.norm(full, axis=1, keepdims=True)
    found = right = 0
    for q in [i for i in range(len(ids)) if ids[i] % 50 == 0]:
        c = full @ full[q]
        c[q] = -9
        want = ids[np.lexsort((ids, -np.round(c, 9)))[:5]].tolist()
        mine = [(r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == ids[q]), key=lambda r: r["rank"])]
        assert len(mine) == 5 and ids[q] not in [m[0] for m in mine] and [m[1] for m in mine] == sorted((m[1] for m in mine), reverse=True)
        found, right = found + 5, right + len({m[0] for m in mine} & set(want))
        if ids[q] == 50:
            assert [m[0] for m in mine] == [3000, 3001, 3002, 3003, 3004]
    assert right / found >= 0.9
    few = df.where("vec_id < 3")
    assert neighbours.nearest(few, few.where("vec_id = 0"), 5).count() == 2
    assert neighbours.nearest(df.limit(0), df.limit(0), 5).count() == 0


@pytest.mark.parametrize("n", [2_000, 8_000])
def test_neighbours_recall_with_blocks_far_smaller_than_the_table(spark, n):
    x = np.random.default_rng(n).standard_normal((n, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {(r["query_id"], r["vec_id"]) for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), 5, block=32, orders=2).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit[::20] @ unit.T
    near[np.arange(len(near)), np.arange(0, n, 20)] = -2
    best = {(20 * q, int(v)) for q, vs in enumerate(np.argsort(-near, axis=1)[:, :5]) for v in vs}
    assert len(got & best) >= 0.93 * len(best)


def test_neighbours_send_a_row_for_each_pair_of_parts_not_for_each_edge(spark):
    def sent():
        store, none = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList()
        stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    n = 3_000
    x = np.random.default_rng(1).standard_normal((n, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    before = sent()
    assert neighbours.nearest(df, df.where("vec_id % 50 = 0"), 5, block=256, orders=2).count() == 5 * n // 50
    assert sent() - before < 40 * n


def test_what_is_sent_to_one_node_has_a_bound(spark):
    m, degree = 500, 4
    graph = neighbours._packed(neighbours.GRAPH, 3, ids=np.tile(7 << neighbours.PLACE | np.arange(degree), m), d=np.repeat(np.arange(m) / m, degree), flag=np.ones(m * degree))
    edges = neighbours._edges(degree, 9)(3, neighbours._table([graph]))
    assert [e["part"] for e in edges] == [7] and len(edges[0]["at"]) == 4 * 9 * degree  # 9 for each of the four nodes
    assert set(np.frombuffer(edges[0]["ids"], np.int64)) == {3 << neighbours.PLACE | i for i in range(9)}


def test_urls(spark):
    urls = [
        (1, "https://Blog.Example.ORG/es/1?x=1"), (2, "http://example.org/en/1x"), (3, "http://a.com/de/x"), (4, "http://a.com/fr/"), (5, "http://casino-win.example.net/a"), (6, "http://plain.example.net/b"),
        (7, None), (8, "no scheme"), (9, "x://"), (10, "http://h?://z"), (6, "http://plain.example.net/b"), (None, "http://notexample.org/es/"), (12, "http://xorg/es/"), (13, "http://a.org#f"),
    ]
    df = spark.createDataFrame([(*u, "h") for u in urls], "page_id long, url string, host string")
    train = spark.createDataFrame([(f"http://{'casino-win' if i % 4 == 0 else 'plain'}{i % 9}.example.net/{i}",) for i in range(400)], "url string")
    model = url_filter.fit(url_filter.labelled_urls(train))
    got = {(r["page_id"], r["url"]): r for r in url_filter.judge(df.select("page_id", "url"), model).collect()}
    pick = lambda i: next(r for (p, _), r in got.items() if p == i)
    assert (pick(1)["host"], pick(1)["path"], pick(1)["rule"], pick(1)["verdict"]) == ("blog.example.org", "/es/1", "example.org/es/", "block")
    assert (pick(2)["rule"], pick(3)["rule"], pick(4)["rule"]) == ("example.org/en/1", "com/de/", "com/fr/")
    assert (pick(3)["verdict"], pick(4)["verdict"], pick(5)["verdict"], pick(6)["verdict"]) == ("block", "allow", "block", "allow")
    assert (pick(7)["host"], pick(7)["path"]) == (pick(8)["host"], pick(8)["path"]) == ("", "") and pick(9)["host"] == ""
    assert pick(None)["rule"] == "org/" and pick(12)["rule"] is None and pick(13)["path"] == "" and pick(10)["host"] == "h"
    empty = url_filter.fit(url_filter.labelled_urls(train.limit(0)))
    assert {r["verdict"] for r in url_filter.judge(df.where("page_id = 6").select("page_id", "url"), empty).collect()} == {"allow"}


def test_scripts_do_not_leak():
    page = "<article><p>a b c.</p><script src=https://cdn.x/>alert(1)</script><p>d e f.</p></article>"
    assert [b.text for b in html_text.blocks(page)] == ["a b c.", "d e f."]
    assert [b.text for b in html_text.blocks("<p>one<object>two</p><p>three</p>")][-1] == "three"


def test_suffix_rates_do_not_see_their_own_labels(spark):
    rows = [(f"http://h{i}.example.org/x{i}", float(i % 2), i % 2) for i in range(40)]
    urls = spark.createDataFrame(rows, "url string, label double, fold int").withColumn("host", url_filter.host_of(F.col("url")))
    stats = url_filter.suffix_stats(urls, 0.5).collect()
    assert len(stats) == 4  # two suffixes, each seen from either fold
    rates = {(r["suffix"], r["fold"]): r["rate"] for r in stats}
    assert rates[("org", 0)] > 0.5 > rates[("org", 1)] and {r["all_rate"] for r in stats} == {0.5}
