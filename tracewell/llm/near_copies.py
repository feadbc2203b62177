"""Near copies by the Jaccard similarity of word shingles, for the corpus pipeline.

A text is the set of its WORDS-word shingles. Texts with equal sets are one node. Each set is sketched by BANDS x ROWS minimum
hashes; nodes that agree in a whole band share a bucket, which two sets of similarity s do with probability
1 - (1 - s^ROWS)^BANDS: 0.9996 at 0.8. All nodes of a bucket that no links join yet are compared by their whole sets (of 32-bit
hashes); those of SIMILARITY or more are linked:

1. In a few ROUNDS each bucket takes one node as its representative, by one of several orders, and compares the others with it.
   Those that are linked to it leave the bucket's round, not the later steps.
2. Buckets whose nodes are all in one component by now can add nothing, and are done with.
3. In the others all pairs from different components are compared: pair by pair in buckets of up to SMALL nodes, in larger ones
   block by block. A block holds about BLOCK shingles; each two blocks of a bucket are one group, so memory is bounded and a
   large bucket is dealt out. Two blocks of one component are not compared. The time of this step grows with the square of a
   bucket's nodes if these are alike but not near copies; nothing is left out for it.

The SimHash fingerprints of the sets, linked at 4 or fewer differing bits by simhash's pigeonring chains, are the other way to
candidates: nodes of linked fingerprints (of equal ones the least stands for all) that the buckets have not brought together are
compared by their sets too. Alone these would not do: of 64 bits about ten differ at 0.8. Links make components.

Defined results: words are those of simhash; a text of fewer than WORDS words is one shingle; null and empty texts, and those
without words, are copies of each other. Repeated rows get the same result. A null doc_id is passed over in component ids; a
component of null ids alone has a null id. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import durable, map_texts
from tracewell.llm.components import components
from tracewell.llm import simhash

WORDS = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 5
#: Buckets of up to SMALL nodes take their representatives by an order of their own; larger ones share ORDERS orders, so that
#: a node of a large group is compared with a few. ROUNDS: how many representatives a bucket takes.
SMALL = 16
ORDERS = 3
ROUNDS = 2
#: Shingles in a block of a large bucket, a text counting as LEAST at least, so that a block's texts are bounded too; shingles
#: that are counted at once when two blocks are compared.
BLOCK = 1 << 16
LEAST = 128
COLUMNS = 1 << 10

_rng = np.random.default_rng(5)
_TIMES = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    return np.unique(np.array(simhash.shingle_hashes(text, words), np.uint64))


def key(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def bands(hashes: np.ndarray) -> list[int]:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[i : i + 1024, None] * _TIMES + _PLUS).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64).tolist()


def _sketches():
    def work(texts):
        sets = [shingles(t) for t in texts]
        return [[key(s) for s in sets], [bands(s) for s in sets], [simhash.fingerprint_of(s) for s in sets]]

    return work


def _sets():
    def work(texts):
        sets = [shingles(t) for t in texts]
        return [[key(s) for s in sets], [np.unique(s.astype(np.uint32)).view(np.int32) for s in sets]]

    return work


def alike(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of pairs(u, v) whose sets(id, hashes) have that similarity at least."""
    one, other = sets.select(F.col("id").alias("u"), F.col("hashes").alias("x")), sets.select(F.col("id").alias("v"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(one, "u").join(other, "v").where(both >= similarity * (F.size("x") + F.size("y") - both)).select("u", "v")


def represented(members: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """members(bucket, id, n: nodes of the bucket), sets(id, hashes) -> u, v: nodes and representatives of a bucket with that similarity at least."""
    found, left = sets.select(F.col("id").alias("u"), F.col("id").alias("v")).limit(0), members
    for _ in range(ROUNDS):
        own = F.when(F.col("n") <= SMALL, F.col("bucket")).otherwise(F.pmod("bucket", F.lit(ORDERS)))
        order = F.struct(F.xxhash64("id", own).alias("h"), "id")
        lead = left.groupBy("bucket").agg(F.min(order).alias("lead")).select("bucket", F.col("lead.id").alias("v"))
        pairs = durable(left.withColumnRenamed("id", "u").join(lead, "bucket").where("u <> v"), "pairs")
        if pairs.isEmpty():
            break
        asked = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        near = durable(alike(asked, sets, similarity), "near")
        found = found.union(near)
        both_ways = near.union(near.select("v", "u"))
        gone = pairs.join(both_ways, ["u", "v"], "left_semi").select("bucket", F.col("u").alias("id")).union(lead.select("bucket", F.col("v").alias("id")))
        left = durable(left.join(gone.distinct(), ["bucket", "id"], "left_anti"), "left")
    return found


def _near_in_blocks(similarity: float):
    """Of one block (side 0) or two (0 and 1), rows id, root, side, hashes: each node that near copies across roots join to a
    lesser one, and the least that it is joined to. Only the joins count, so a dense group gives a row for each node."""

    def run(table: pa.Table) -> pa.Table:
        id_, root, side = (table.column(c).to_numpy() for c in ("id", "root", "side"))
        sets = table.column("hashes").combine_chunks()
        size = np.diff(sets.offsets.to_numpy())
        row = np.repeat(np.arange(len(size)), size)
        _, token, times = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
        number = np.cumsum(times > 1) - 1  # of the shingles that several have
        row, token = row[times[token] > 1], number[token[times[token] > 1]]
        order = np.argsort(token, kind="stable")
        row, token = row[order], token[order]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if side.any() else left
        both = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, int(token[-1]) + 1 if len(token) else 0, COLUMNS):
            a, b = np.searchsorted(token, [at, at + COLUMNS])
            has = np.zeros((len(size), COLUMNS), np.float32)
            has[row[a:b], token[a:b] - at] = 1
            both += has[left] @ has[right].T
        both = both.astype(np.float64)
        near = (both >= similarity * (size[left][:, None] + size[right] - both)) & (root[left][:, None] != root[right])
        x, y = np.nonzero(near)
        x, y = left[x], right[y]
        order = np.argsort(id_)
        least = np.argsort(order)  # ranks of ids
        while True:
            before = least.copy()
            np.minimum.at(least, x, before[y])
            np.minimum.at(least, y, before[x])
            least = least[order[least]]
            if (least == before).all():
                break
        u, v = id_, id_[order[least]]
        return pa.table({"u": u[u != v], "v": v[u != v]})

    return run


def compared(members: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """members(bucket, id, n), roots(u, v: the root of u's component; none: itself) -> u, v: joins of all nodes that share a
    bucket, have that similarity at least and different roots."""
    known = members.join(roots.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").withColumn("root", F.coalesce("root", "id"))
    several = known.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    still = durable(known.join(several, "bucket", "left_semi").select("bucket", "id", "root", "n"), "still")

    few = still.where(F.col("n") <= SMALL).select("bucket", "id", "root")
    one, other = few.select("bucket", F.col("id").alias("u"), F.col("root").alias("ru")), few.select("bucket", F.col("id").alias("v"), F.col("root").alias("rv"))
    found = alike(one.join(other, "bucket").where("u < v and ru <> rv").select("u", "v").distinct(), sets, similarity)

    # Components of over BLOCK shingles in a bucket have blocks of their own (whose: the root), the others share blocks (-1).
    many = still.where(F.col("n") > SMALL).join(sets.select("id", F.greatest(F.size("hashes"), F.lit(LEAST)).alias("size")), "id")
    own = many.groupBy("bucket", "root").agg(F.sum("size").alias("sum")).withColumn("whose", F.when(F.col("sum") > BLOCK, F.col("root")).otherwise(F.lit(-1)))
    parts = own.groupBy("bucket", "whose").agg(F.ceil(F.sum("sum") / BLOCK).alias("parts"))
    place = own.select("bucket", "root", "whose").join(parts, ["bucket", "whose"])
    part = F.pmod(F.xxhash64(F.when(F.col("whose") < 0, F.col("root")).otherwise(F.col("id"))), F.greatest("parts", F.lit(1)))
    dealt = durable(many.join(place, ["bucket", "root"]).select("bucket", "id", "root", F.struct("whose", part.alias("part")).alias("block")), "dealt")
    blocks = dealt.select("bucket", "block").distinct()
    meet = blocks.withColumnRenamed("block", "a").join(blocks.withColumnRenamed("block", "b"), "bucket").where("a <= b and (a.whose < 0 or a.whose <> b.whose)")
    sides = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("block"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("a").alias("block"), F.lit(0).alias("side")), F.struct(F.col("b").alias("block"), F.lit(1).alias("side")))
    )
    sent = meet.select("bucket", "a", "b", F.explode(sides).alias("s")).select("bucket", "a", "b", "s.block", "s.side")
    rows = dealt.join(sent, ["bucket", "block"]).join(sets, "id").select("bucket", "a", "b", "id", "root", "side", "hashes")
    return found.union(rows.groupBy("bucket", "a", "b").applyInArrow(_near_in_blocks(similarity), "u long, v long"))


def links(members: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """members(bucket, id, n: nodes of the bucket), sets(id, hashes) -> u, v: each node that isn't the least of its component, and
    that least node; components are those of all pairs that share a bucket and have that similarity at least."""
    roots = components(represented(members, sets, similarity))
    return components(roots.union(compared(members, roots, sets, similarity)))


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """nodes(id, fp) -> u, v: nodes whose fingerprints are equal (each with the least of them) or linked (the least of either)."""
    distinct = durable(nodes.groupBy("fp").agg(F.min("id").alias("id")), "distinct")
    same = nodes.select("id", "fp").join(distinct.select("fp", F.col("id").alias("v")), "fp").where("id <> v").select(F.col("id").alias("u"), "v")
    return same.union(simhash.links(distinct.select("fp", "id")).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable by links): one row for each of docs."""
    texts = docs.select("doc_id", "text")
    prints = durable(map_texts(texts, "text", "key binary, bands array<long>, fp long", _sketches).select("row.doc_id", "key", "bands", "fp"), "sketches")
    nodes = durable(prints.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("fp").alias("fp")).withColumn("id", F.monotonically_increasing_id()), "nodes")
    members = nodes.select("id", F.explode("bands").alias("bucket"))
    members = durable(members.join(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket").select("bucket", "id", "n"), "members")
    close = durable(fingerprint_links(nodes), "close")
    alone = members.select("id").union(close.select("u")).union(close.select("v")).distinct()
    asked = nodes.join(alone, "id", "left_semi").select("id", "key")
    whole = map_texts(texts, "text", "key binary, hashes array<int>", _sets).select("key", "hashes")
    sets = durable(whole.join(asked, "key").groupBy("id").agg(F.first("hashes").alias("hashes")), "sets")
    met = links(members, sets)
    of = lambda c: met.select(F.col("u").alias(c), F.col("v").alias(f"{c}_root"))
    apart = close.join(of("u"), "u", "left").join(of("v"), "v", "left").where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v")
    edges = components(met.select("u", "v").union(alike(apart, sets)))
    root = nodes.join(edges.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select("key", "least", F.coalesce("root", "id").alias("root"))
    least = root.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.select("doc_id", "key").join(root.join(least, "root").select("key", "component_id"), "key").select("doc_id", "component_id")
