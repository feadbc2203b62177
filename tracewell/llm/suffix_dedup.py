"""Suffix-array dedup: removes every byte of a text that a string of SPAN bytes covers which also starts in a document with
a smaller doc_id. Texts are UTF-8 bytes, matches never cross documents, and strings are judged on the input.

1. Anchors. Of the GRAM-byte strings in each SPAN-byte window the one with the least hash (the leftmost, if equal) is the
   window's anchor. Equal windows have equal anchors at equal offsets. So windows are compared anchor by anchor: an anchor's
   context is the text of all windows that it is the anchor of. A document has about one anchor in 14 bytes.
2. Within a batch of documents, contexts that several documents hold are compared (see 4). Those whose every window stands in
   a smaller document of the batch go no further, which is the aggregation before the shuffle. The others' hashes are dealt
   out by anchor, packed: each row of the exchange holds all anchors of one bucket from one batch.
3. In a bucket, anchors that only one document has are dropped. The contexts of the others are read from the documents, and
   dealt out by anchor again, now with their bytes.
4. An anchor's contexts are sorted by suffix arrays, built by linear grouping (grouping_sort.py). Contexts of equal bytes are
   one text of the array, which stands for all documents that hold it. The suffixes that share SPAN bytes are one string; its
   least document keeps it, and in every other document that holds it its place is covered.
5. Covered stretches go back to the documents.

Hashes only bring together what may be equal; what is equal is told by bytes. All exchanges are by hash of anchors or
documents, with bucket counts that grow with the input, so that a task's share stays the same. Anchors in very many contexts
(a passage that a third of all documents quote has some at its ends) are found in a sample of the documents; their windows are
dealt out one by one, by the hash of all their bytes, so that no bucket holds them all. Other anchors with more than MANY
contexts are split inside their bucket (_split), which keeps each suffix array short. Neither leaves anything out.

Rows have a number besides their doc_id (the same where ids are unique), which tells rows with one id apart; what is sent is
its difference, by bits.

Defined results: a null text is empty; a null doc_id comes after all others, and rows without one are not compared with each
other; rows that share a doc_id are not compared with each other either, each being judged against smaller ids; texts of under
SPAN bytes lose nothing; an empty table gives an empty result. Other columns are carried as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tracewell.llm.common import durable, read_table
from tracewell.llm.grouping_sort import _ranges, suffix_arrays

SPAN = 50
GRAM = 24
MANY = 16
#: Text bytes that are looked through at once, anchors in a bucket, text bytes in a bucket of documents: about so many.
BATCH_BYTES = 1 << 20
BUCKET_BYTES = 8 << 20
DOCS_BYTES = 6 << 20
#: Tasks that compare contexts, at most: the blobs are small for the work that is in them, so their number is set here.
MOST_TASKS = 20_000
#: Bytes of contexts whose suffix arrays are built together.
COMPARE_BYTES = 1 << 18
#: Bytes of contexts that are looked at together.
CHUNK_BYTES = 2 << 20
#: Contexts whose bytes are fetched or compared in one step: each byte takes a few numbers of eight bytes for as long.
CHUNK_ROWS = 1 << 15
#: One document in SAMPLED is looked through for anchors that are in about HOT contexts or more; at most MOST_HOT of them, the
#: most frequent, are dealt out by windows.
SAMPLED, HOT, MOST_HOT = 64, 16_384, 100_000
SIDE = SPAN - GRAM
#: Documents whose texts are compressed at once.
BUCKET_ROWS = 1000
#: Bits of an anchor's hash that are sent: with about half a million anchors in a bucket few meet that are not equal.
GRAM_BITS = 28
LAST = np.iinfo(np.int64).max

_rng = np.random.default_rng(99)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    """Spreads each bit of a hash over all others."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


@lru_cache(1)
def _powers(blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base, and of its inverse: `blocks` times 2^18."""
    return tuple(np.r_[np.uint64(1), np.cumprod(np.full((blocks << 18) - 1, x, np.uint64))] for x in (_BASE, _BACK))


class Hashes:
    """Hashes of any substrings of a buffer, from running sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers((len(data) >> 18) + 1)
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(_BYTE.take(data) * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays of one length, each as planes of bytes, compressed: small numbers cost little."""
    planes = b"".join(np.ascontiguousarray(a.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays)
    return zstd.ZstdCompressor(level=1).compress(planes)


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstd.ZstdDecompressor().decompress(blob), np.uint8)
    each = len(planes) // columns
    return [np.ascontiguousarray(planes[i * each : (i + 1) * each].reshape(8, -1).T).view("<u8").ravel() for i in range(columns)]


def _gathered(blobs: pa.ChunkedArray, columns: int) -> list[np.ndarray]:
    parts = [unpack(b.as_py(), columns) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) for i in range(columns)]


def anchors(data: np.ndarray, start: np.ndarray, stop: np.ndarray, hot: np.ndarray | None = None) -> list[np.ndarray]:
    """Of documents data[start:stop]: document number, place in data, hash of the anchor, hash of its context, bytes of the
    context before and behind the anchor. An anchor in `hot` gives each of its windows as a context, with the hash of the
    window's bytes in place of its own."""
    none = [np.empty(0, np.int64)] * 2 + [np.empty(0, np.uint64)] * 2 + [np.empty(0, np.int64)] * 2
    n, w = len(data), SIDE + 1
    if n < SPAN:
        return none
    hashes = Hashes(data)
    gram = _mix(hashes(np.arange(n - GRAM + 1), np.arange(GRAM, n + 1)))
    least, reach = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64), 1
    while reach < w:
        step = min(reach, w - reach)
        least, reach = np.minimum(least[:-step], least[step:]), reach + step
    windows = _ranges(start, np.maximum(0, stop - start - SPAN + 1))
    if not len(windows):
        return none
    at = (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    at, left = at[head], at[head] - windows[head]
    right = windows[np.r_[head[1:], len(windows)] - 1] + SIDE - at
    gram = gram[at]
    if hot is not None and len(hot):
        split = hot[np.minimum(np.searchsorted(hot, gram), len(hot) - 1)] == gram
        times = np.where(split, left + right - SIDE + 1, 1)
        first, row = SIDE - right, np.repeat(np.arange(len(at)), times)
        before = _ranges(np.where(split, first, left), times)
        at, split = at[row], split[row]
        left, right = before, np.where(split, SIDE - before, right[row])
        gram = np.where(split, _mix(hashes(at - left, at + GRAM + right) + np.uint64(3)), gram[row])
    doc = np.searchsorted(stop, at, side="right")
    return [doc, at, gram, _context_hash(hashes, at, left, right), left, right]


def _context_hash(hashes: Hashes, mid: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mix(hashes(mid - left, mid + GRAM + right) + (left * 64 + right + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _by_bucket(bucket: np.ndarray, columns: list[np.ndarray], order: tuple) -> Iterator[tuple[int, bytes]]:
    sort = np.lexsort((*order, bucket))
    bucket, columns = bucket[sort], [c[sort] for c in columns]
    head = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for a, b in zip(head, [*head[1:], len(bucket)], strict=False):
        yield int(bucket[a]), pack(*[c[a:b] for c in columns])


def _blob_batch(kinds: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kinds] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["kind", "bucket", "blob"])


def _doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(doc.astype(np.uint64) + np.uint64(7)) % np.uint64(buckets)).astype(np.int64)


_BLOBS = "kind int, bucket long, blob binary"
ANCHOR, COVERED, WANTED, CONTEXT = range(4)


def _covered_batch(number: np.ndarray, at: np.ndarray, size: np.ndarray, doc_buckets: int) -> pa.RecordBatch:
    """Covered stretches, those that touch joined, by bucket of documents."""
    sort = np.lexsort((at, number))
    found = merged(number[sort], at[sort], size[sort])
    return _blob_batch(COVERED, list(_by_bucket(_doc_bucket(found[0], doc_buckets), found, (found[1], found[0]))))


def _batches(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list]:
    """Rows with texts of SPAN bytes or more, about BATCH_BYTES of text at once: the columns `names`, and the texts' bytes."""
    rows, size = [], 0
    for b in batches:
        for *row, text in zip(*[b.column(c).to_pylist() for c in names], b.column("text"), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            if len(raw) >= SPAN:
                rows.append((*row, raw))
                size += len(raw)
            if size >= BATCH_BYTES:
                yield list(zip(*rows, strict=True))
                rows, size = [], 0
    if rows:
        yield list(zip(*rows, strict=True))


def _several(*keys: np.ndarray, who: np.ndarray) -> np.ndarray:
    """For rows sorted by keys and who: whether other documents share the keys."""
    head = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    run = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(who)]))
    return (who[head] < who[np.r_[head[1:], len(who)] - 1])[run]


def hot_anchors(own: DataFrame, sampled: int = SAMPLED, hot: int = HOT) -> np.ndarray:
    """Anchors in about `hot` contexts or more, as far as one document in `sampled` tells, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in _batches(batches, ()):
            size = np.array([len(t) for t in texts], np.int64)
            stop = np.cumsum(size)
            _, _, gram, context, _, _ = anchors(np.frombuffer(b"".join(texts), np.uint8), stop - size, stop)
            sort = np.lexsort((context, gram))
            gram, context = gram[sort], context[sort]
            found, n = np.unique(gram[np.r_[True, (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])][: len(gram)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["gram", "n"])

    part = own.where(F.pmod(F.xxhash64("number"), F.lit(sampled)) == 0).select("text")
    counts = part.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, hot // sampled))
    return np.sort(np.array([r["gram"] for r in counts.orderBy(F.desc("n"), "gram").limit(MOST_HOT).collect()], np.int64).view(np.uint64))


def _send_anchors(buckets: int, doc_buckets: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, numbers, texts in _batches(batches, ("ord", "number")):
            size = np.array([len(t) for t in texts], np.int64)
            stop, data = np.cumsum(size), np.frombuffer(b"".join(texts), np.uint8)
            doc, mid, gram, context, left, right = anchors(data, stop - size, stop, hot.value)
            who, number = np.array(ids, np.int64)[doc], np.array(numbers, np.int64)[doc]
            at = mid - (stop - size)[doc]
            sort = np.lexsort((at, who, context, gram))
            who, number, mid, at, gram, context, left, right = (x[sort] for x in (who, number, mid, at, gram, context, left, right))
            shared = np.flatnonzero(_several(gram, context, who=who))
            left_out = np.zeros(len(who), bool)
            if len(shared):
                hashes, found = Hashes(data), []
                for part in _by_groups(gram[shared], left[shared] + GRAM + right[shared]):
                    part = shared[part]
                    row, before, runs = covered(data, mid[part], left[part], right[part], who[part], gram[part], hashes=hashes)
                    found.append([part[row], before, runs])
                row, before, runs = (np.concatenate(x) for x in zip(*found, strict=True))
                yield _covered_batch(number[row], at[row] - before, runs + SPAN - 1, doc_buckets)
                left_out[row[runs == left[row] + right[row] - SIDE + 1]] = True
            rows = [x[~left_out] for x in (gram >> np.uint64(64 - GRAM_BITS), who, number ^ who, at, left, right)]
            yield _blob_batch(ANCHOR, list(_by_bucket((gram[~left_out] % np.uint64(buckets)).astype(np.int64), rows, (rows[0],))))

    return run


def _match_contexts(doc_buckets: int):
    """Of one bucket's anchors: those that several documents have, by bucket of documents."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == COVERED:  # known already
            return table
        gram, who, differ, at, left, right = _gathered(table.column("blob"), 6)
        sort = np.lexsort((who, gram))
        gram, who, differ, at, left, right = (x[sort] for x in (gram, who, differ, at, left, right))
        pick = _several(gram, who=who)
        number, bucket = (who ^ differ)[pick], np.full(int(pick.sum()), table.column("bucket")[0].as_py(), np.uint64)
        gram = np.cumsum(np.r_[True, gram[1:] != gram[:-1]][: len(gram)] & pick)  # from here on a number in the bucket
        rows = [number, *[x[pick] for x in (differ, at, left, right, gram)], bucket]
        return pa.Table.from_batches([_blob_batch(WANTED, list(_by_bucket(_doc_bucket(number, doc_buckets), rows, (rows[2], rows[0]))))])

    return run


def _fetch_contexts(left_table: pa.Table, right_table: pa.Table) -> pa.Table:
    """A bucket of documents, and the contexts wanted of them -> contexts with their bytes, by anchor bucket."""
    empty = pa.table({"kind": pa.array([], pa.int32()), "bucket": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
    if not left_table.num_rows or not right_table.num_rows:
        return empty
    number, differ, at, left, right, gram, bucket = (x.astype(np.int64) for x in _gathered(right_table.column("blob"), 7))
    data, place = _joined(left_table)
    begin = place(number, at) - left
    length = left + GRAM + right
    sort = np.lexsort((gram, bucket))
    rows, head = [], np.flatnonzero(np.r_[True, np.diff(bucket[sort]) != 0])
    for a, b in zip(head, [*head[1:], len(sort)], strict=True):
        part = sort[a:b]
        meta = pack(gram[part], number[part], differ[part], at[part], left[part], right[part])
        text = b"".join(data[_ranges(begin[p], length[p])].tobytes() for p in (part[i : i + CHUNK_ROWS] for i in range(0, len(part), CHUNK_ROWS)))
        rows.append((int(bucket[part[0]]), len(meta).to_bytes(8, "little") + meta + zstd.ZstdCompressor(level=1).compress(text)))
    return pa.Table.from_batches([_blob_batch(CONTEXT, rows)])


def _texts(docs: pa.Table) -> list[bytes]:
    """The bytes of the texts that _with_bucket compressed."""
    whole = zstd.ZstdDecompressor().decompress
    return [b"" if t is None else whole(t) for t in docs.column("text").to_pylist()]


def _joined(docs: pa.Table):
    """The texts of a bucket of documents end to end, and a function from (row number, place in the text) to places in them."""
    texts = _texts(docs)
    size = np.array([len(t) for t in texts], np.int64)
    number = docs.column("number").to_numpy().astype(np.int64)
    order = np.argsort(number)
    start, number = (np.cumsum(size) - size)[order], number[order]

    def place(numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        return start[np.searchsorted(number, numbers)] + at

    return np.frombuffer(b"".join(texts), np.uint8), place


def _alike(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes data[a:a+size] and data[b:b+size] are equal, for each."""
    out = np.zeros(len(a), bool)
    for i in range(0, len(a), CHUNK_ROWS):
        x, y, n = (v[i : i + CHUNK_ROWS] for v in (a, b, size))
        differ = data[_ranges(x, n)] != data[_ranges(y, n)]
        out[i : i + CHUNK_ROWS] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
    return out


def _heads(data: np.ndarray, hashes: Hashes, mid: np.ndarray, left: np.ndarray, right: np.ndarray, who: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each context the one that stands for it: that of the least document among those of its group with equal bytes."""
    h = _context_hash(hashes, mid, left, right)
    sort = np.lexsort((who, h, group))
    new = np.r_[True, (group[sort][1:] != group[sort][:-1]) | (h[sort][1:] != h[sort][:-1])][: len(mid)]
    head = np.empty(len(mid), np.int64)
    head[sort] = sort[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(mid) else sort
    other = np.flatnonzero((head != np.arange(len(head))) & (left == left[head]) & (right == right[head]))
    same = np.arange(len(head)) == head
    same[other] = _alike(data, mid[other] - left[other], mid[head[other]] - left[other], left[other] + GRAM + right[other])
    return np.where(same, head, np.arange(len(head)))  # equal hashes of other bytes: it stands for itself


def _split(hashes: Hashes, mid: np.ndarray, left: np.ndarray, right: np.ndarray, key: np.ndarray, many: int) -> list[np.ndarray]:
    """Splits groups (by key) of over `many` different contexts until none is larger: contexts, bytes before and behind the
    anchor that count, group.

    A window has some number j of bytes before the anchor, from 0 to SIDE, and the rest behind it. Windows with j up to m share
    the least rest behind, those with more share m + 1 bytes before: a context goes into one group by the one and into another
    by the other, and in each only the bytes that such windows can reach count. Halving the range of j again and again ends
    where a window is wholly given."""
    rows, number = np.arange(len(mid)), 0
    low, high = np.zeros(len(rows), np.int64), np.full(len(rows), SIDE)
    out = []
    while len(rows):
        l, r = np.minimum(left[rows], high), np.minimum(right[rows], SIDE - low)
        h = _context_hash(hashes, mid[rows], l, r)
        sort = np.lexsort((h, key))
        rows, low, high, l, r, h, key = (x[sort] for x in (rows, low, high, l, r, h, key))
        new_key = np.r_[True, key[1:] != key[:-1]]
        new = new_key | np.r_[True, h[1:] != h[:-1]]
        group = np.cumsum(new_key) - 1
        done = (np.bincount(group[new])[group] <= many) | (low == high)
        out.append([rows[done], l[done], r[done], group[done] + number])
        number += int(new_key.sum())
        rows, low, high, group = rows[~done], low[~done], high[~done], group[~done].astype(np.uint64)
        m = (low + high) // 2
        behind, ahead = right[rows] >= SIDE - m, left[rows] >= m + 1
        k1 = _mix(hashes(mid[rows] - low, mid[rows] + GRAM + np.minimum(right[rows], SIDE - m)) + group * np.uint64(2))
        k2 = _mix(hashes(mid[rows] - np.minimum(left[rows], m + 1), mid[rows] + GRAM + np.minimum(right[rows], SIDE - high)) + group * np.uint64(2) + np.uint64(1))
        key = np.r_[k1[behind], k2[ahead]]
        low, high, rows = np.r_[low[behind], m[ahead] + 1], np.r_[m[behind], high[ahead]], np.r_[rows[behind], rows[ahead]]
    return [np.concatenate([x[i] for x in out or [[np.empty(0, np.int64)] * 4]]) for i in range(4)]


def least_documents(data: np.ndarray, start: np.ndarray, stop: np.ndarray, who: np.ndarray, group: np.ndarray) -> list[np.ndarray]:
    """Contexts data[start:stop] of documents `who`, in groups: context, place, least document for each SPAN-byte string in
    them, the document being that of the group's contexts that hold the string. By the groups' suffix arrays."""
    order = np.argsort(group, kind="stable")
    start, stop, who_sorted = start[order], stop[order], who[order]
    head = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
    size = stop - start + 1  # with a 1 between contexts, a 0 at the end of each group
    at = np.cumsum(size) - size
    values = np.ones(size.sum(), np.int64)
    values[_ranges(at, size - 1)] = data[_ranges(start, size - 1)].astype(np.int64) + 2
    lengths = np.add.reduceat(size, head)
    values[np.cumsum(lengths) - 1] = 0
    text = np.repeat(np.arange(len(head)), lengths)
    context = np.repeat(np.arange(len(order)), size)
    suffixes = suffix_arrays(values, lengths)
    whole = suffixes[(at + size - 1)[context[suffixes]] - suffixes >= SPAN]  # with SPAN bytes to go
    same = np.zeros(len(whole), bool)
    live = np.flatnonzero(text[whole[1:]] == text[whole[:-1]])
    words = np.zeros(len(values) - 7, np.uint64)  # eight bytes from each place on
    for i in range(8):
        words |= (values[i : len(values) - 7 + i] - 2 & 0xFF).astype(np.uint64) << np.uint64(8 * i)
    for i in (*range(0, SPAN - 8, 8), SPAN - 8):
        live = live[words[whole[live] + i] == words[whole[live + 1] + i]]
    same[live + 1] = True
    least = np.minimum.reduceat(who_sorted[context[whole]], np.flatnonzero(~same))[np.cumsum(~same) - 1]
    return [order[context[whole]], whole - at[context[whole]], least]


def covered(data: np.ndarray, mid: np.ndarray, left: np.ndarray, right: np.ndarray, who: np.ndarray, group: np.ndarray, many: int = MANY, hashes: Hashes | None = None) -> list[np.ndarray]:
    """Contexts around anchors at data[mid], of documents `who`, in groups -> context, bytes before the anchor, number of
    windows: each run of windows from there on that also stand in a context of the group with a smaller document."""
    hashes = hashes or Hashes(data)
    sort = np.lexsort((who, group))
    use = np.empty(len(mid), bool)
    use[sort] = _several(group[sort], who=who[sort]) if len(mid) else use
    rows = np.flatnonzero(use)
    head = rows[_heads(data, hashes, mid[rows], left[rows], right[rows], who[rows], group[rows])] if len(rows) else rows
    texts, text = np.unique(head, return_inverse=True)
    piece, l, r, part = _split(hashes, mid[texts], left[texts], right[texts], group[texts], many)
    at = mid[texts][piece]
    stands = _heads(data, hashes, at, l, r, who[texts][piece], part)
    kept, kept_of = np.unique(stands, return_inverse=True)
    kept = kept[np.lexsort((part[kept], np.bincount(part[kept])[part[kept]]))] if len(kept) else kept  # groups of like size together
    place = np.empty(len(piece), np.int64)
    place[kept] = np.arange(len(kept))
    begin, size, own = (at - l)[kept], (l + GRAM + r)[kept], part[kept]
    least = np.full((len(kept), SIDE + 1), LAST)  # of a piece, by bytes before the anchor
    edges = np.flatnonzero(np.r_[True, np.diff(own) != 0]) if len(own) else np.empty(0, np.int64)
    total, a = np.cumsum(size), 0
    while a < len(kept):
        b = int(np.searchsorted(total, (total[a - 1] if a else 0) + COMPARE_BYTES, side="right"))
        b = int(edges[np.searchsorted(edges, max(b, a + 1), side="left")]) if b < len(kept) and edges[-1] >= max(b, a + 1) else len(kept)
        c, p, n = least_documents(data, begin[a:b], begin[a:b] + size[a:b], who[texts][piece][kept[a:b]], own[a:b])
        least[a + c, l[kept[a:b]][c] - p] = n
        a = b
    of_text = np.full((len(texts), SIDE + 1), LAST)
    for i in range(0, len(piece), 1 << 16):  # each window of a text is in one of its pieces
        part_least = least[place[stands[i : i + (1 << 16)]]]
        x, j = np.nonzero(part_least < LAST)
        of_text[piece[i : i + (1 << 16)][x], j] = part_least[x, j]
    out = []
    for i in range(0, len(rows), 1 << 16):
        mine = rows[i : i + (1 << 16)]
        hit = np.zeros((len(mine), SIDE + 3), bool)  # in the order of places: bytes before the anchor go down
        hit[:, 1:-1] = (who[mine][:, None] > of_text[text[i : i + (1 << 16)]])[:, ::-1]
        x, first = np.nonzero(hit[:, 1:] & ~hit[:, :-1])
        _, last = np.nonzero(hit[:, :-1] & ~hit[:, 1:])
        out.append([mine[x], SIDE - first, last - first])
    return [np.concatenate([x[i] for x in out or [[np.empty(0, np.int64)] * 3]]) for i in range(3)]


def _by_groups(group: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers of some whole groups at a time, of about CHUNK_BYTES, where equal groups stand together."""
    edges, total, a = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]), np.cumsum(size), 0
    while a < len(group):
        b = int(np.searchsorted(total, (total[a - 1] if a else 0) + CHUNK_BYTES, side="right"))
        b = int(edges[np.searchsorted(edges, max(b, a + 1), side="left")])
        yield np.arange(a, b)
        a = b


def merged(row: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Stretches sorted by row and start -> row, start, size, those of a row that overlap or touch being one."""
    if not len(row):
        return [row, start, size]
    first = np.r_[True, row[1:] != row[:-1]]
    # Rows are laid one behind the other, each as long as its stretches reach, with a gap: ends only grow.
    reach = np.maximum.reduceat(start + size, np.flatnonzero(first)) + 1
    lift = (np.cumsum(reach) - reach)[np.cumsum(first) - 1]
    ends = np.maximum.accumulate(lift + start + size)
    head = np.flatnonzero(first | np.r_[True, lift[1:] + start[1:] > ends[:-1]])
    tail = np.r_[head[1:], len(row)] - 1
    return [row[head], start[head], ends[tail] - lift[tail] - start[head]]


def _compare_contexts(doc_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        metas, texts = [], []
        for b in table.column("blob"):
            raw = b.as_py()
            n = int.from_bytes(raw[:8], "little")
            metas.append([x.astype(np.int64) for x in unpack(raw[8 : 8 + n], 6)])
            texts.append(zstd.ZstdDecompressor().decompress(raw[8 + n :]))
        gram, number, differ, at, left, right = (np.concatenate([m[i] for m in metas]) for i in range(6))
        data, size = np.frombuffer(b"".join(texts), np.uint8), left + GRAM + right
        del metas, texts
        start, order, found = np.cumsum(size) - size, np.argsort(gram, kind="stable"), []
        for part in _by_groups(gram[order], size[order]):
            rows = order[part]
            stop = np.cumsum(size[rows])
            row, before, runs = covered(data[_ranges(start[rows], size[rows])], stop - GRAM - right[rows], left[rows], right[rows], (number ^ differ)[rows], gram[rows])
            found.append([number[rows][row], at[rows][row] - before, runs + SPAN - 1])
        return pa.Table.from_batches([_covered_batch(*(np.concatenate(x) for x in zip(*found, strict=True)), doc_buckets)])

    return run


def _cut(docs: pa.Table, covered: pa.Table, as_text: bool) -> pa.Table:
    """A bucket of documents and what is covered in them -> removed stretches and kept bytes, as text or as they are."""
    texts = _texts(docs)
    spans: list = [[] for _ in texts]
    kept = list(texts)
    if docs.num_rows and covered.num_rows:
        data, place = _joined(docs)
        number, at, length = (x.astype(np.int64) for x in _gathered(covered.column("blob"), 3))
        begin = place(number, at)
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + length, -1)
        inside = np.cumsum(edge[:-1], out=edge[:-1]) > 0
        del edge, begin, number, length
        at = 0
        for i, t in enumerate(texts):
            mine = inside[at : at + len(t)]
            if mine.any():
                turn = np.flatnonzero(np.diff(np.r_[False, mine, False]))
                spans[i] = [{"start": int(a), "stop": int(b)} for a, b in zip(turn[::2], turn[1::2], strict=True)]
                kept[i] = data[at : at + len(t)][~mine].tobytes()
            at += len(t)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    if as_text:
        left = pa.array([None if null else k.decode("utf-8", "ignore") for k, null in zip(kept, docs.column("text").is_null().to_pylist(), strict=True)], pa.string())
    else:
        left = pa.array(kept, pa.binary())
    return pa.table({"row": docs.column("row"), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "removed": pa.array(spans, kind), "kept": left})


def removals(docs: DataFrame, as_text: bool = False, sampled: int = SAMPLED, hot: int = HOT) -> DataFrame:
    """row (docs' columns but text), n_bytes, removed (stretches, start and stop in bytes), kept: the other bytes, or as_text their
    text, without bytes that are left of a character that lost others (null where the text is)."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    ids = docs.where("doc_id is not null").groupBy("doc_id").count()
    repeated = not ids.where("count > 1").isEmpty() or docs.where("doc_id is null").limit(2).count() > 1
    own = docs.select(F.struct(*others).alias("row"), F.coalesce("doc_id", F.lit(int(LAST))).alias("ord"), "text")
    # The number of a row, by which it is found again: the id where that tells rows apart, else a new one, written down.
    own = durable(own.withColumn("number", F.monotonically_increasing_id()), "rows") if repeated else own.withColumn("number", F.col("ord"))
    total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets, doc_buckets = max(12, total // BUCKET_BYTES), max(12, total // DOCS_BYTES)
    split = docs.sparkSession.sparkContext.broadcast(hot_anchors(own, sampled, hot))
    sent = own.select("ord", "number", "text").mapInArrow(_send_anchors(buckets, doc_buckets, split), _BLOBS)
    matched = durable(sent.groupBy("kind", "bucket").applyInArrow(_match_contexts(doc_buckets), _BLOBS), "matched")
    by_doc = _with_bucket(own, doc_buckets)
    wanted = matched.where(F.col("kind") == WANTED)
    contexts = by_doc.select("number", "text", "bucket").groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInArrow(_fetch_contexts, _BLOBS)
    compared = durable(contexts.repartition(min(buckets, MOST_TASKS), "bucket").groupBy("bucket").applyInArrow(_compare_contexts(doc_buckets), _BLOBS), "compared")
    covered = matched.where(F.col("kind") == COVERED).unionByName(compared)
    schema = StructType([*by_doc.select("row").schema.fields, *StructType.fromDDL("n_bytes long, removed array<struct<start: long, stop: long>>, kept " + ("string" if as_text else "binary")).fields])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        return _cut(left, right, as_text)

    return by_doc.groupBy("bucket").cogroup(covered.groupBy("bucket")).applyInArrow(cut, schema)


def _with_bucket(own: DataFrame, buckets: int) -> DataFrame:
    """The documents with the number that _doc_bucket gives them, and with compressed texts: these are shuffled twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstd.ZstdCompressor(level=1).compress
        for b in (b.slice(at, BUCKET_ROWS) for b in batches for at in range(0, b.num_rows, BUCKET_ROWS)):
            texts = pa.array([None if (t := x.as_py()) is None else small(t.encode("utf-8", "surrogatepass")) for x in b.column("text")], pa.binary())
            columns = {n: texts if n == "text" else c for n, c in zip(b.schema.names, b.columns, strict=True)}
            columns["bucket"] = pa.array(_doc_bucket(b.column("number").to_numpy(), buckets), pa.int64())
            yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

    kept = [StructField("text", BinaryType()) if f.name == "text" else f for f in own.schema.fields]
    return own.mapInArrow(run, StructType([*kept, StructField("bucket", LongType())]))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with the kept part of their texts (n_chars, if there is one, anew). Bytes that are left of a character
    that lost others are dropped. A null text stays null."""
    out = removals(docs, as_text=True)
    found = {c: F.col(f"row.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("kept")}
    if "n_chars" in found:
        kind = dict(docs.dtypes)["n_chars"]
        found["n_chars"] = F.when(F.size("removed") > 0, F.length("kept").cast(kind)).otherwise(found["n_chars"])
    return out.select(*[found[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = removals(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return out.select("row.doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(doc_id, {int(LAST)}) AS o, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, o, unnest(range(0, len(h) // 2 - {SPAN - 1})) AS i, unnest(list_transform(range(0, len(h) // 2 - {SPAN - 1}), lambda i: h[2 * i + 1:2 * i + {2 * SPAN}])) AS g FROM d),
least AS (SELECT g, min(o) AS least FROM w GROUP BY g HAVING min(o) < max(o)),
hit AS (SELECT DISTINCT rid, i FROM w JOIN least USING (g) WHERE o > least),
runs AS (SELECT rid, i, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -1000) > {SPAN} AS new FROM hit),
numbered AS (SELECT rid, i, sum(new::INT) OVER (PARTITION BY rid ORDER BY i) AS k FROM runs),
spans AS (SELECT rid, k, min(i) AS a, max(i) + {SPAN} AS b FROM numbered GROUP BY rid, k),
pieces AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS from_, lead(a) OVER (PARTITION BY rid ORDER BY a) IS NULL AS last FROM spans),
cut AS (SELECT rid, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(d.h[2 * from_ + 1:2 * a] || CASE WHEN last THEN d.h[2 * b + 1:] ELSE '' END, '' ORDER BY a) AS kept FROM pieces JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (rid)
"""
