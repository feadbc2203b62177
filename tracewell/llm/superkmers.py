"""Substring dedup by super-k-mers: removes every word that a window of WINDOW consecutive words covers whose word sequence also
starts earlier, in a document with a smaller doc_id or before it in the same document. Words are runs of anything but ASCII
white space; windows never cross documents and are judged on the input.

1. A window's minimiser is the MINI-word string of least hash in it (the leftmost, if equal). Consecutive windows with one
   minimiser are one super-k-mer: their words travel as one packed string, not window by window, to the minimiser's bucket.
   Equal windows have equal minimisers, so they meet; and since they have them at equal offsets, no two windows of one
   super-k-mer are equal.
2. A part of the buckets is a group of the exchange. Packed strings travel in zstandard blobs, all that a stretch of text has
   for one part in each. In a part, equal strings are one, then all windows are sorted by hash, and equal hashes are told by
   bytes: the first window of each content in order of (doc_id, start) stays.
3. First windows go back to their documents as bits; every other window covers its words.

Hot buckets (a passage that a third of the documents hold has some at its ends, with other words around it each time) are
found by counting minimisers in a sample of one in SAMPLE documents, and their windows are dealt out one by one, as keys of an
aggregation for the least place, which sums up before it shuffles. The list of hot buckets has MOST_HOT entries at most. It
changes only by which way a window goes, and equal windows go the same way: nothing is dropped or left uncompared.
Memory: a task holds PART_BYTES or so of packed strings, a document, or the strings of a bucket that is not hot.

Defined results: a null text has no words; texts of under WINDOW words lose nothing; a null doc_id comes after all others. Rows
with one doc_id are ordered by the hash of their texts, so that equal rows have equal results and neither loses words to the
other. Ids are compared as whole numbers. Other columns are carried as they are. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import durable, map_texts, read_table

WINDOW = 20
MINI = 6
#: Bytes of text that are looked through at once, of packed strings that are put into blobs together, and of those in a part.
BLOCK = 1 << 20
BLOB_BYTES = 12 << 20
PART_BYTES = 16 << 20
#: Packed bytes to a byte of text: (windows of a super-k-mer + WINDOW - 1) words for each of its windows.
SPREAD = 1 + 2 * (WINDOW - 1) / (WINDOW - MINI + 2)
#: A bucket of more strings than HOT is hot; one in SAMPLE documents is counted.
HOT = 4096
SAMPLE = 16
MOST_HOT = 1 << 20
KEY = ("late", "doc_id", "tie")

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(2)
def _power_table(base: int, size: int) -> np.ndarray:
    table = np.full(size, base, np.uint64)
    table[0] = 1
    return np.cumprod(table)


def _powers(base: int, n: int) -> np.ndarray:
    size = 1 << max(20, (n - 1).bit_length())
    make = _power_table if size <= 1 << 22 else _power_table.__wrapped__
    return make(base, size)[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each start, the same wherever these values stand."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(_BASE, len(values)), out=total[1:])
    return _mixed((total[ends] - total[starts]) * _powers(_INVERSE, len(values) + 1)[starts])


def _words(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes, ends and hashes of words that single spaces or line ends part."""
    raw = np.frombuffer(buf, np.uint8)
    gaps = np.flatnonzero((raw == 32) | (raw == 10))
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(buf)]])
    return starts, ends, _rolled(raw.astype(np.uint64) + np.uint64(1), starts, ends)


def _least_places(h: np.ndarray, span: int) -> np.ndarray:
    """For each stretch of span values the place of the least, the leftmost of equal ones."""

    def joined(at: np.ndarray, shift: int) -> np.ndarray:
        left, right = at[:-shift], at[shift:]
        return np.where(h[left] <= h[right], left, right)

    at, reach = np.arange(len(h)), 1
    while reach * 2 <= span:
        at, reach = joined(at, reach), reach * 2
    return joined(at, span - reach) if reach < span else at


def _pieces(text: bytes) -> Iterator[tuple[int, bytes]]:
    """A text's words, joined by single spaces, in pieces of about BLOCK bytes that overlap by a window less a word, each with
    the number of its first word. Each window is in one piece."""
    whole, at, word = b" ".join(text.split()), 0, 0
    if whole.count(b" ") < WINDOW - 1:
        return
    while True:
        end = whole.find(b" ", at + BLOCK)
        while end >= 0 and (n := whole.count(b" ", at, end) + 1) < WINDOW:
            end = whole.find(b" ", end + 1)
        if end < 0:
            yield word, whole[at:]
            return
        piece = whole[at:end]
        yield word, piece
        at, word = at + len(piece.rsplit(b" ", WINDOW - 1)[0]) + 1, word + n - WINDOW + 1


def _blocks(texts: list) -> Iterator[list[tuple[int, int, bytes]]]:
    """(row, number of the first word, piece) of texts, about BLOCK bytes together."""
    block, size = [], 0
    for row, text in enumerate(texts):
        for word, piece in _pieces(text or b""):
            block.append((row, word, piece))
            size += len(piece)
            if size >= BLOCK:
                yield block
                block, size = [], 0
    if block:
        yield block


class SuperKmers:
    """The super-k-mers of a block: row, start (number of the first window in its document), windows, first and end (bytes of
    buf), bucket; each an array."""

    def __init__(self, block: list[tuple[int, int, bytes]]):
        self.buf = b" ".join(piece for _, _, piece in block)
        self.starts, self.ends, hashes = _words(self.buf)
        counts = np.array([piece.count(b" ") + 1 for _, _, piece in block])
        last = np.cumsum(counts)
        places = np.arange(len(hashes) - MINI + 1)
        h = _rolled(hashes, places, places + MINI)
        piece = np.repeat(np.arange(len(block)), counts)
        window = np.arange(len(hashes) - WINDOW + 1)
        window = window[window + WINDOW <= last[piece[: len(window)]]]
        least = _least_places(h, WINDOW - MINI + 1)[window]
        new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (window[1:] != window[:-1] + 1)]))
        begin, final = window[new], window[np.concatenate([new[1:], [len(window)]]) - 1]
        self.windows, self.bucket = final - begin + 1, h[least[new]]
        at = piece[begin]
        self.row = np.array([r for r, _, _ in block])[at]
        self.start = begin - (last - counts)[at] + np.array([w for _, w, _ in block])[at]
        self.word, self.first, self.end = begin, self.starts[begin], self.ends[final + WINDOW - 1]

    def strings(self, which: np.ndarray) -> list[bytes]:
        return [self.buf[a:b] for a, b in zip(self.first[which].tolist(), self.end[which].tolist(), strict=True)]

    def single_windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Rows, starts and words of each window."""
        n = self.windows[which]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        word = np.repeat(self.word[which], n) + step
        texts = [self.buf[a:b] for a, b in zip(self.starts[word].tolist(), self.ends[word + WINDOW - 1].tolist(), strict=True)]
        return np.repeat(self.row[which], n), np.repeat(self.start[which], n) + step, texts


def _key(docs: DataFrame, ids: str, text: str) -> list[Column]:
    """late (no id), doc_id, tie (a hash of the text where some id has several rows, else 0) and the text as bytes."""
    number, words = F.col(f"`{ids}`").cast("bigint"), F.col(f"`{text}`").cast("binary")
    repeated = not docs.groupBy(number).count().where("count > 1").isEmpty()
    tie = F.xxhash64(words) if repeated else F.lit(0).cast("bigint")
    return [number.isNull().alias("late"), F.coalesce(number, F.lit(0)).alias("doc_id"), tie.alias("tie"), words.alias("words")]


def _is_hot(hot: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(bucket), bool)
    return hot[np.minimum(np.searchsorted(hot, bucket), len(hot) - 1)] == bucket


def hot_buckets(keyed: DataFrame) -> np.ndarray:
    """The buckets of more than HOT strings, by a sample; sorted, MOST_HOT of them at most, the largest first."""

    def counted(batches):
        for batch in batches:
            for block in _blocks(batch.column(0).to_pylist()):
                bucket, n = np.unique(SuperKmers(block).bucket.view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n)], names=["bucket", "n"])

    sample = keyed.where(F.pmod(F.xxhash64("doc_id", "tie", F.length("words")), F.lit(SAMPLE)) == 0).select("words")
    sums = sample.mapInArrow(counted, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = sums.where(F.col("n") > HOT // SAMPLE).orderBy(F.desc("n"), "bucket").limit(MOST_HOT).select("bucket").collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def _parts(n: int, hot: np.ndarray):
    """Maps documents to (part, blob): the super-k-mers of buckets that are not hot, in n parts."""

    def blobs(held: list) -> pa.RecordBatch:
        late, doc, tie, start, bucket = (np.concatenate([x[i] for x in held]) for i in range(5))
        texts = [t for x in held for t in x[5]]
        part, sub = (bucket % np.uint64(n)).astype(np.int64), ((bucket // np.uint64(n)) & np.uint64(0xFFFF)).astype(np.uint16)
        order = np.lexsort((sub, part))
        borders = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0]))
        pack, out = zstd.ZstdCompressor(level=3), []
        for some in np.split(order, borders[1:]):
            body = b"\n".join([texts[i] for i in some.tolist()])
            out.append(pack.compress(b"".join([np.int64(len(some)).tobytes(), sub[some].tobytes(), late[some].tobytes(), doc[some].tobytes(), tie[some].tobytes(), start[some].tobytes(), body])))
        return pa.RecordBatch.from_arrays([pa.array(part[order][borders]), pa.array(out, pa.binary())], names=["part", "blob"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            late, doc, tie = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for block in _blocks(batch.column(3).to_pylist()):
                s = SuperKmers(block)
                cold = np.flatnonzero(~_is_hot(hot, s.bucket))
                row = s.row[cold]
                held.append((late[row], doc[row], tie[row], s.start[cold], s.bucket[cold], s.strings(cold)))
                size += int((s.end[cold] - s.first[cold]).sum())
                if size >= BLOB_BYTES:
                    yield blobs(held)
                    held, size = [], 0
        if held:
            yield blobs(held)

    return run


def _opened(blob: bytes) -> tuple[list[np.ndarray], list[bytes]]:
    raw = zstd.ZstdDecompressor().decompress(blob)
    n, at, columns = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind in (np.uint16, np.bool_, np.int64, np.int64, np.int64):
        columns.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return columns, raw[at:].split(b"\n")


def first_windows(texts: list[bytes]) -> np.ndarray:
    """For packed strings in order of place, bits of the windows that no earlier string holds. The strings are different, and
    windows within one are."""
    buf = b"\n".join(texts)
    starts, ends, hashes = _words(buf)
    counts = np.array([t.count(b" ") + 1 for t in texts])
    last = np.cumsum(counts)
    window = np.arange(len(hashes) - WINDOW + 1)
    row = np.repeat(np.arange(len(texts)), counts)[: len(window)]
    fits = window + WINDOW <= last[row]
    window, row = window[fits], row[fits]
    h = _rolled(hashes, window, window + WINDOW)
    order = np.argsort(h, kind="stable")
    alike = h[order][1:] == h[order][:-1]
    first = np.ones(len(window), bool)
    again = np.concatenate([[False], alike])
    some = order[again | np.concatenate([alike, [False]])]  # windows whose hash others have: told by bytes, in order of place
    seen: set = set()
    h_some = h[some].tolist()
    for i, (a, b) in enumerate(zip(starts[window[some]].tolist(), ends[window[some] + WINDOW - 1].tolist(), strict=True)):
        if i and h_some[i] != h_some[i - 1]:
            seen = set()
        words = buf[a:b]
        if words in seen:
            first[some[i]] = False
        seen.add(words)
    begins = np.concatenate([[0], np.cumsum(counts - WINDOW + 1)[:-1]])
    return np.add.reduceat(first.astype(np.int64) << (np.arange(len(window)) - begins[row]), begins)


def _firsts_of_part(table: pa.Table) -> pa.Table:
    """(late, doc_id, tie, start, bits) of the strings of a part that hold first windows. Buckets are looked at some at a time."""
    opened = [_opened(b) for b in table.column("blob").to_pylist()]
    columns = [np.concatenate([c[i] for c, _ in opened]) for i in range(5)]
    texts = [t for _, found in opened for t in found]
    sub, late, doc, tie, start = columns
    order = np.lexsort((start, tie, doc, late, sub))
    size = np.cumsum(np.array([len(t) for t in texts])[order])
    out, bits, at, mine, done = [], [], 0, sub[order], 0
    while at < len(order):
        to = int(np.searchsorted(mine, mine[min(len(order) - 1, int(np.searchsorted(size, done + BLOCK)))], side="right"))
        different: dict = {}
        some = order[at:to]
        for i in some[np.lexsort((start[some], tie[some], doc[some], late[some]))].tolist():
            different.setdefault(texts[i], i)
        found = first_windows(list(different))
        rows = np.fromiter(different.values(), np.int64, len(different))
        out.append(rows[found > 0])
        bits.append(found[found > 0])
        at, done = to, int(size[to - 1])
    rows = np.concatenate(out)
    return pa.table({"late": late[rows], "doc_id": doc[rows], "tie": tie[rows], "start": start[rows], "bits": np.concatenate(bits)})


def _hot_windows(hot: np.ndarray):
    """Maps documents to the windows of hot buckets, those of a block that are equal once, at their least place."""

    def run(batches):
        for batch in batches:
            late, doc, tie = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for block in _blocks(batch.column(3).to_pylist()):
                s = SuperKmers(block)
                row, start, texts = s.single_windows(np.flatnonzero(_is_hot(hot, s.bucket)))
                least: dict = {}
                for i in np.lexsort((start, tie[row], doc[row], late[row])).tolist():
                    least.setdefault(texts[i], i)
                at = np.fromiter(least.values(), np.int64, len(least))
                columns = [pa.array(list(least), pa.binary()), *(pa.array(c[row[at]]) for c in (late, doc, tie)), pa.array(start[at])]
                yield pa.RecordBatch.from_arrays(columns, names=["window", *KEY, "start"])

    return run


def firsts(keyed: DataFrame) -> DataFrame:
    """keyed: the columns of _key. (late, doc_id, tie, start, bits): bit i is set if the window that starts at word start + i is the first of its content."""
    size = keyed.agg(F.sum(F.length("words"))).first()[0] or 0
    hot = hot_buckets(keyed)
    blobs = keyed.mapInArrow(_parts(max(1, round(size * SPREAD / PART_BYTES)), hot), "part bigint, blob binary")
    fields = "late boolean, doc_id bigint, tie bigint, start bigint"
    cold = blobs.groupBy("part").applyInArrow(_firsts_of_part, f"{fields}, bits bigint")
    if not len(hot):
        return cold
    windows = keyed.mapInArrow(_hot_windows(hot), f"window binary, {fields}")
    least = windows.groupBy("window").agg(F.min(F.struct(*KEY, "start")).alias("at"))
    return cold.unionByName(least.select("at.*", F.lit(1).cast("bigint").alias("bits")))


def _kept(text: bytes | None, found: list[int] | None) -> tuple[int, int, bytes]:
    """Words, words removed, and the kept ones joined. found: start * 2^16 + bits of first windows."""
    words = (text or b"").split()
    n = len(words)
    if n < WINDOW:
        return n, 0, b" ".join(words)
    packed = np.array(found or [], np.int64)
    repeats = np.ones(n - WINDOW + 1, bool)
    for i in range(WINDOW - MINI + 1):
        repeats[(packed >> 16)[(packed >> i) & 1 == 1] + i] = False
    change = np.zeros(n + 1, np.int64)
    change[:-WINDOW] += repeats
    change[WINDOW:] -= repeats
    covered = np.cumsum(change)[:n] > 0
    gone = int(covered.sum())
    return n, gone, b" ".join(words if not gone else [words[i] for i in np.flatnonzero(~covered).tolist()])


def deduplicated(docs: DataFrame, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """docs as a struct `row`, and n_words, n_removed, kept (the kept words joined by one space, as bytes)."""
    key = _key(docs, ids, text)
    found = durable(firsts(docs.select(*key)), "first-windows").groupBy(*KEY).agg(F.collect_list(F.shiftleft("start", 16).bitwiseOR(F.col("bits"))).alias("found"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), *key)
    both = rows.join(found, list(KEY), "left").select("own", F.struct("words", "found").alias("both"))

    def make():
        def work(values):
            done = [_kept(v["words"], v["found"]) for v in values]
            return [list(c) for c in zip(*done, strict=True)] if done else [[], [], []]

        return work

    return map_texts(both, "both", "n_words bigint, n_removed bigint, kept binary", make).select(F.col("row.own").alias("row"), "n_words", "n_removed", "kept")


def report(docs: DataFrame) -> DataFrame:
    return deduplicated(docs).select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS g FROM d WHERE len(w) >= {WINDOW}),
again AS (SELECT rid, i FROM (SELECT rid, i, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, i) AS k FROM s) WHERE k > 1),
gone AS (SELECT rid, list(DISTINCT p) AS ps FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM again) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (rid)
"""
