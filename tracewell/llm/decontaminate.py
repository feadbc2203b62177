"""Benchmark decontamination by suffix arrays over the training documents.

Each Arrow batch of documents is a shard. Words become integers, those of no benchmark item become 0, and stretches of
benchmark words that are too short for any window are left out, as no window can be in them. A suffix array is built over
what stays (prefix doubling, numpy), and every benchmark suffix is searched in it by bisection, all at once; the interval
found holds each place where its window occurs, and matches are then lengthened as far as they go. Documents never move:
a pass has no shuffle. The benchmark goes to the tasks in parts of about PART_WORDS words: a pass over the documents for each,
with what it found written to the shared folder before the next one. The driver and the tasks hold one part at a time, so
that what is broadcast is bounded whatever the benchmark's size. Most benchmarks are one part, and one pass.

Words: A-Z lower-cased, then runs of anything but ASCII characters other than letters and digits. A window is WINDOW
consecutive words of an item; an item with fewer, but not none, is one window.

Defined results: a null text has no words and is never contaminated; an item with a null or empty text has no window; an
item with a null id counts for hits, but is not listed; repeated items are listed once, repeated documents are judged
alike; an empty benchmark contaminates nothing; an empty table gives an empty result. Other columns are carried as they are.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import UPPER, durable, map_texts, read_table

WINDOW = 10
#: Words of the benchmark that are searched in one pass.
PART_WORDS = 500_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
COLUMNS = "n_words long, spans array<struct<start: int, length: int>>, items array<string>, longest int"


def words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of s by their first `depth` values (at least); the end sorts first."""
    rank, order, k = np.unique(s, return_inverse=True)[1].astype(np.int64) + 1, None, 1
    while True:
        if k >= depth or rank.max(initial=0) == len(s):
            return np.argsort(rank, kind="stable")
        behind = np.zeros(len(s), np.int64)
        behind[:-k] = rank[k:]
        rank, k = np.unique(rank * (len(s) + 2) + behind, return_inverse=True)[1].astype(np.int64) + 1, 2 * k


class Part:
    """A part of the benchmark, ready for searching."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        self.stream: list[int] = []
        self.windows: dict[int, dict[tuple, tuple[int, set]]] = defaultdict(dict)  # by length and words: start, items
        for item, ws in items:
            at, ids = len(self.stream), [self.vocabulary[w] for w in ws]
            self.stream += [*ids, 0]
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                _, found = self.windows[n].setdefault(tuple(ids[i : i + n]), (at + i, set()))
                if item is not None:
                    found.add(item)
        self.stream = np.array(self.stream or [0], np.int64)
        self.least = min(self.windows, default=0)
        self.deepest = max((len(ws) for _, ws in items), default=0)

    def search(self, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set, int]]:
        """For each document: stretches of hit words (start, length), items, words of the longest match."""
        none = [([], set(), 0) for _ in docs]
        if not self.windows:
            return none
        get = self.vocabulary.get
        ids = np.fromiter((x for ws in docs for x in (*[get(w, 0) for w in ws], 0)), np.int64)
        first = np.cumsum([0] + [len(ws) + 1 for ws in docs])
        edges = np.flatnonzero(np.diff(np.r_[False, ids > 0, False]))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.least
        starts, lengths = starts[long], (ends - starts)[long] + 1  # with the 0 behind
        if not len(starts):
            return none
        offset = np.cumsum(np.r_[0, lengths[:-1]])
        place = np.repeat(starts - offset, lengths) + np.arange(lengths.sum())
        s = ids[place]
        order = suffix_array(s, max(self.windows))
        s_pad, t_pad = np.r_[s, np.zeros(max(self.windows) + 1, np.int64)], np.r_[self.stream, np.zeros(max(self.windows) + 1, np.int64)]
        found = []
        for n, windows in self.windows.items():
            at = np.array([v[0] for v in windows.values()])
            low, high = self._interval(s_pad, order, t_pad[at[:, None] + np.arange(n)])
            hit = np.flatnonzero(high > low)
            count = (high - low)[hit]
            which = np.repeat(hit, count)
            pos = order[np.repeat(low[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            owners = [v[1] for v in windows.values()]
            found.append((place[pos], np.full(len(pos), n), self._lengthen(s_pad, pos, t_pad, at[which], n), [owners[w] for w in which]))
        pos, n, full = (np.concatenate([x[i] for x in found]) for i in range(3))
        owners = [o for x in found for o in x[3]]
        doc = np.searchsorted(first, pos, side="right") - 1
        for i in np.lexsort((pos, doc)):
            spans, items, longest = none[d := doc[i]]
            a, b = int(pos[i] - first[d]), int(pos[i] - first[d] + n[i])
            if spans and a <= spans[-1][0] + spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][0] + spans[-1][1], b) - spans[-1][0])
            else:
                spans.append((a, b - a))
            items.update(owners[i])
            none[d] = (spans, items, max(longest, int(full[i])))
        return none

    @staticmethod
    def _interval(s: np.ndarray, order: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern, the range of the suffix array whose suffixes start with it, by bisection of all at once."""
        out = []
        for after in (False, True):
            low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(order))
            while (open_ := low < high).any():
                mid = (low + high) // 2
                d = s[order[np.minimum(mid, len(order) - 1)][:, None] + np.arange(patterns.shape[1])] - patterns
                sign = np.sign(d[np.arange(len(d)), np.argmax(d != 0, axis=1)])
                right = (sign < 0) | (after & (sign == 0))
                low, high = np.where(open_ & right, mid + 1, low), np.where(open_ & ~right, mid, high)
            out.append(low)
        return out[0], out[1]

    @staticmethod
    def _lengthen(s: np.ndarray, pos: np.ndarray, t: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Words that match from each pair of places on."""
        length, live = np.full(len(pos), n), np.arange(len(pos))
        while len(live):
            a, b = s[np.minimum(pos[live] + length[live], len(s) - 1)], t[np.minimum(at[live] + length[live], len(t) - 1)]
            live = live[(a == b) & (a > 0)]
            length[live] += 1
        return length


def parts(benchmark: DataFrame, part_words: int = PART_WORDS, window: int = WINDOW) -> Iterator[Part]:
    """The benchmark in parts of about part_words words, one at least. Items are read one after the other, and a part is closed
    when it is full."""
    items, n, made = [], 0, False
    for r in benchmark.select(F.col("item_id").cast("string").alias("item"), "text").toLocalIterator():
        ws = words(r["text"])
        items.append((r["item"], ws))
        n += len(ws)
        if n >= part_words:
            yield Part(items, window)
            items, n, made = [], 0, True
    if items or not made:
        yield Part(items, window)


def _found(part) -> Callable:
    """A pass: what a broadcast part finds in texts, beside what earlier passes found."""

    def make():
        def work(values: list[dict]) -> list[list]:
            texts = [words(v["text"]) for v in values]
            found = part.value.search(texts)
            before = [[(x["start"], x["length"]) for x in v.get("spans") or ()] for v in values]
            return [
                [len(ws) for ws in texts],
                [[{"start": a, "length": n} for a, n in merge([*old, *f[0]])] for old, f in zip(before, found, strict=True)],
                [sorted({*(v.get("items") or ()), *f[1]}) for v, f in zip(values, found, strict=True)],
                [max(v.get("longest") or 0, f[2]) for v, f in zip(values, found, strict=True)],
            ]

        return work

    return make


def matches(docs: DataFrame, benchmark: DataFrame, part_words: int = PART_WORDS, window: int = WINDOW) -> DataFrame:
    """row (docs' columns), n_words, spans (stretches of hit words), items (ids, sorted as strings), longest."""
    seen, shared = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.struct("text").alias("seen")), None
    for part in parts(benchmark, part_words, window):
        if shared:
            done = durable(done, "parts")
            shared.destroy()
            seen = done.select(F.col("row").alias("own"), F.struct("row.text", "spans", "items", "longest").alias("seen"))
        shared = docs.sparkSession.sparkContext.broadcast(part)
        done = map_texts(seen, "seen", COLUMNS, _found(shared)).select(F.col("row.own").alias("row"), "n_words", "spans", "items", "longest")
    return done


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, n in sorted(spans):
        if out and a <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][0] + out[-1][1], a + n) - out[-1][0])
        else:
            out.append((a, n))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The documents without any window of the benchmark, with their own columns."""
    return matches(docs, benchmark, **params).where(F.size("spans") == 0).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    return found.select(
        "row.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


_SQL_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT item, least(len(w), {WINDOW}) AS n, unnest(list_transform(range(1, len(w) - least(len(w), {WINDOW}) + 2), lambda i: array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM d, ns WHERE len(w) >= n),
hit AS (SELECT DISTINCT rid, i, n, g FROM dw SEMI JOIN bw USING (n, g)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hit JOIN bw USING (n, g) WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""
