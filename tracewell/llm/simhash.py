"""SimHash near-duplicates with pigeonring filtering.

A text's fingerprint has bit b set if over half of the XXH64 hashes of its 4-word shingles have it. Two fingerprints are
linked if they differ in at most 4 bits, and links make components.

Pigeonring: the 64 bits are cut into 5 segments in a ring. If two fingerprints differ in at most 4 bits, then from some
segment on every chain of 1, 2, ... 5 consecutive segments differs in at most 4/5 of a bit a segment: in none, 1, 2, 3 and 4
bits. Candidates are found by an equi-join on the first two segments of the chain (26 bits: the first alike, the second
alike or with one bit flipped), the longer chains prune them one after the other, and the full chain is the Hamming check.
Equal fingerprints are one row throughout, so groups of copies are never paired.

Defined results: a null or empty text, or one without words, has fingerprint 0; such texts are linked like any other. A text
of fewer than 4 words is one shingle. Repeated rows get the same result. A null doc_id is passed over in component ids; a
component of null ids alone has a null id. An empty table gives an empty result. grouped gives these columns alone,
deduplicated keeps all of docs'.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import durable, map_texts, read_table
from tracewell.llm.components import components

WORDS = 4
SEED = 42
LIMIT = 4
WIDTHS = (13, 13, 13, 13, 12)
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def shingle_hashes(text: str | None, size: int = WORDS) -> list[int]:
    """The hash of each shingle of `size` words, of all words if there are fewer; none without words."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return []
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(words) - size + 1]
    return [digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)]


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint, as a signed integer."""
    return fingerprint_of(shingle_hashes(text))


def fingerprint_of(hashes) -> int:
    """The 64-bit fingerprint of shingles' hashes, as a signed integer; 0 for none."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """row (docs' columns), fingerprint."""

    def make():
        return lambda texts: [[fingerprint(t) for t in texts]]

    return map_texts(docs, "text", "fingerprint long", make)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _segments(widths=WIDTHS) -> list[tuple[int, int]]:
    """(offset, mask within the segment)"""
    at = np.cumsum([0, *widths[:-1]]).tolist()
    return [(a, (1 << w) - 1) for a, w in zip(at, widths, strict=True)]


def _cut(fp: Column, segment: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(fp, segment[0]).bitwiseAND(F.lit(segment[1]).cast("long"))


def _key(i: int, first: Column, second: Column) -> Column:
    return F.lit(i << 32).cast("long") + F.shiftleft(first, 16) + second


def links(prints: DataFrame, limit: int = LIMIT, widths=WIDTHS) -> DataFrame:
    """prints(fp, id), each fp once -> a, b (ids), one row or more for each pair at no more than `limit` bits."""
    segments, m = _segments(widths), len(widths)
    if not m > limit >= 1 or 2 * limit // m != 1:
        raise ValueError("the join needs one segment alike and at most one differing bit in the next")
    fp = F.col("fp")
    index, probe = [], []
    for i in range(m):
        here, after = segments[i], segments[(i + 1) % m]
        first, second = _cut(fp, here), _cut(fp, after)
        index.append(_key(i, first, second))
        flips = [0, *(1 << b for b in range(widths[(i + 1) % m]))]
        probe += [_key(i, first, second.bitwiseXOR(F.lit(f).cast("long"))) for f in flips]
    left = prints.select(fp.alias("x"), F.col("id").alias("a"), F.explode(F.array(*probe)).alias("key"))
    right = prints.select(fp.alias("y"), F.col("id").alias("b"), F.explode(F.array(*index)).alias("key"))
    start, differ = F.shiftright("key", 32), F.col("x").bitwiseXOR(F.col("y"))

    def within(chain: int) -> Column:
        masks = [_signed(sum(segments[(i + j) % m][1] << segments[(i + j) % m][0] for j in range(chain))) for i in range(m)]
        mask = F.element_at(F.array(*map(F.lit, masks)), (start + 1).cast("int"))
        return F.bit_count(differ.bitwiseAND(mask)) <= chain * limit // m

    near = F.col("a") < F.col("b")
    for chain in range(3, m + 1):
        near &= within(chain)
    return left.join(right, "key").where(near).select("a", "b")


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id reachable by links): one row for each of docs."""
    prints = durable(fingerprints(docs.select("doc_id", "text")).select("row.doc_id", "fingerprint"), "prints")
    distinct = durable(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least")).withColumn("id", F.monotonically_increasing_id()), "distinct")
    edges = components(links(distinct.select("fp", "id")).select(F.col("a").alias("u"), F.col("b").alias("v")))
    root = distinct.join(edges.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select("fp", "least", F.coalesce("root", "id").alias("root"))
    least = root.groupBy("root").agg(F.min("least").alias("component_id"))
    found = root.join(least, "root").select(F.col("fp").alias("fingerprint"), "component_id")
    return prints.join(found, "fingerprint").select("doc_id", "fingerprint", "component_id")


def deduplicated(docs: DataFrame, groups=grouped) -> DataFrame:
    """One document of each component, that of the smallest doc_id, with its own columns; documents without an id stay, as
    there is no telling which of a group they are. Of repeated rows with one id one stays. groups gives doc_id, component_id."""
    found = durable(groups(docs), "grouped")
    kept = docs.join(found.where("doc_id = component_id").select("doc_id").distinct(), "doc_id", "left_semi").select(docs.columns)
    if not found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grouped(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
