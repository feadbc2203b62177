"""Audit of sources: how far each source's word frequencies are from the other sources' of its language, and which words set it
apart from the language.

The tokenizer is one translate table: bytes.translate lowers A-Z and blanks every separator in one pass, bytes.split gives the
terms and a Counter for each document their frequencies. A task sums Counters by (language, source) up to HELD entries and
sends (language, source, term, occurrences, documents), which are summed sparsely: only what occurs is a row.

Each language keeps its V terms of at least LEAST_DOCS documents. A group is a (language, source) that occurs, or a language.
Each kept term has in each group p = 1 + floor(10^9 (count + 2) / (N + 2V)), N being the group's occurrences of kept terms. The
divergence of p and q is floor((p - q)^2 / (p + q)). All numbers are exact: counts are multiplied as decimals of 38 digits.

* pair: each other source of the language, with the divergence summed over all kept terms.
* term: a source's TOP terms of largest divergence from the language, among those it has more of than the language.

Sums over pairs take no row for each pair and term: a term is one row with its p in each source of the language, and a task
adds up a table of sources by sources for each language with numpy, in blocks of terms. Its size is that of the result.
Sources are a dimension: a term's row and the ranks of a source's pairs are bounded by their number. Whatever is ranked among
terms is cut to TOP in each task before the exchange.

Defined results: null text, lang and source are empty strings; repeated rows count each time; a source without terms has pairs
and no terms; a language without kept terms has pairs of value 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import durable, read_table

LEAST_DOCS = 10
TOP = 10
#: Entries of (language, source, term) that a task sums up before it sends them.
HELD = 1 << 18
#: Numbers in a block of terms by sources.
BLOCK = 1 << 18
#: Lowers A-Z, keeps a-z and all bytes of characters beyond ASCII, blanks the rest.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERMS).split()


def _counted(batches):
    """(lang, source, text as bytes) -> (lang, source, term, n, docs), summed in the task."""
    n: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}
    held = 0

    def rows():
        columns = [[], [], [], [], []]
        for group, counts in n.items():
            for c, values in zip(columns, ([group[0]] * len(counts), [group[1]] * len(counts), counts.keys(), counts.values(), map(docs[group].__getitem__, counts)), strict=True):
                c.extend(values)
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = Counter(terms_of(text))
            counts = n.setdefault((lang, source), Counter())
            held -= len(counts)
            counts.update(found)
            docs.setdefault((lang, source), Counter()).update(found.keys())
            held += len(counts)
            if held > HELD:
                yield rows()
                n, docs, held = {}, {}, 0
    if held:
        yield rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents with it."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    sums = rows.mapInArrow(_counted, "lang string, source string, term binary, n bigint, docs bigint").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return sums.withColumn("term", F.col("term").cast("string"))


def kept_terms(counts: DataFrame) -> DataFrame:
    """(lang, term, n, by): the terms that a language keeps, with their occurrences in all and by source."""
    both = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("by"))
    return both.where(F.col("docs") >= LEAST_DOCS).drop("docs")


def groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, at, size, v, lang_size): each group, its number in its language, and its N, the language's V and N."""
    occurring = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sizes = kept.select("lang", F.explode("by").alias("b")).groupBy("lang", F.col("b.source").alias("source")).agg(F.sum("b.n").alias("size"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_size"))
    out = occurring.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "v", "lang_size"])
    return out.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)


def share(count: Column, size: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (size + 2 v)), exactly."""
    whole = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (whole(count) + 2), whole(size) + 2 * whole(v)) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_sums(batches):
    """(lang, p in each source) -> (lang, a, b, value) for a < b, summed in the task."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, lists = np.array(batch.column(0).to_pylist(), object), batch.column(1)
        for lang in set(langs.tolist()):
            mine = lists.filter(pa.array(langs == lang))
            width = len(mine[0])
            p = mine.flatten().to_numpy().reshape(-1, width)
            total = sums.setdefault(lang, np.zeros((width, width), np.int64))
            step = max(1, BLOCK // width)
            for k in range(0, len(p), step):
                for a in range(width - 1):
                    one, rest = p[k : k + step, a : a + 1], p[k : k + step, a + 1 :]
                    total[a, a + 1 :] += ((one - rest) ** 2 // (one + rest)).sum(0)
    for lang, total in sums.items():
        for a in range(len(total) - 1):
            b = np.arange(a + 1, len(total))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(b), pa.string()), pa.array(np.full(len(b), a)), pa.array(b), pa.array(total[a, a + 1 :])], names=["lang", "a", "b", "value"])


def pair_values(kept: DataFrame, dims: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each two sources of a language, both ways."""
    by_lang = dims.where("v > 0").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "source", "size", "v"))).alias("all"))
    counts = kept.select("lang", F.map_from_entries("by").alias("by")).join(by_lang, "lang")
    each = F.transform("all", lambda g: share(F.coalesce(F.try_element_at("by", g["source"]), F.lit(0)), g["size"], g["v"]))
    sums = counts.select("lang", each.alias("p")).mapInArrow(_pair_sums, "lang string, a bigint, b bigint, value bigint").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    one = dims.select("lang", "source", F.col("at").alias("x"))
    other = dims.select("lang", F.col("source").alias("item"), F.col("at").alias("y"))
    pairs = one.join(other, "lang").where("x != y").withColumns({"a": F.least("x", "y").cast("bigint"), "b": F.greatest("x", "y").cast("bigint")})
    return pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).cast("bigint").alias("value"))


def term_values(kept: DataFrame, dims: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a source has more of than its language."""
    rows = kept.select("lang", "term", F.col("n").alias("all_n"), F.explode("by").alias("b")).select("lang", "term", "all_n", F.col("b.source").alias("source"), F.col("b.n").alias("n"))
    rows = rows.join(dims, ["lang", "source"]).select("lang", "source", "term", share(F.col("n"), F.col("size"), F.col("v")).alias("p"), share(F.col("all_n"), F.col("lang_size"), F.col("v")).alias("q"))
    return rows.where("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))


def report(docs: DataFrame) -> DataFrame:
    kept = durable(kept_terms(term_counts(docs)), "terms")
    dims = durable(groups(docs, kept), "groups")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_values(kept, dims).withColumn("rank", rank)
    terms = term_values(kept, dims).withColumn("rank", rank).where(F.col("rank") <= TOP)
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(pairs, "pair").unionByName(part(terms, "term"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read_table(spark, sf_dir, "documents"))


_P = "(1 + (1000000000::HUGEINT * ({c} + 2)) // ({n} + 2 * v))"
_F = "((p - q) * (p - q) // (p + q))"
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS raw FROM d),
x AS (SELECT rid, lang, source, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM w),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS all_n FROM x GROUP BY lang, term HAVING count(DISTINCT rid) >= {LEAST_DOCS}),
s AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM x SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS v, sum(all_n) AS lang_size FROM k GROUP BY lang),
z AS (SELECT lang, source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS size FROM g LEFT JOIN s USING (lang, source) GROUP BY lang, source),
p AS (SELECT z.lang, z.source, k.term, coalesce(s.n, 0) AS n, {_P.format(c="coalesce(s.n, 0)", n="z.size")} AS p, {_P.format(c="k.all_n", n="l.lang_size")} AS q
  FROM z JOIN l ON l.lang = z.lang JOIN k ON k.lang = z.lang LEFT JOIN s ON s.lang = z.lang AND s.source = z.source AND s.term = k.term),
o AS (SELECT p.lang, p.source, r.source AS item, sum((p.p - r.p) * (p.p - r.p) // (p.p + r.p)) AS value FROM p JOIN p AS r ON p.lang = r.lang AND p.term = r.term AND p.source <> r.source GROUP BY p.lang, p.source, r.source),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(o.value, 0) AS BIGINT) AS value FROM g JOIN g AS h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.item = h.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST({_F} AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
