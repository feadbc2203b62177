"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only.

Texts are cut into blocks of at most BLOCK_WORDS words. A source with target t and s words in all gives floor(t / s)
whole passes over its blocks, and of one more pass the blocks at the head of a random permutation, up to t rounded; the
block at that border is cut. So each source has an exact quota of blocks. A binary tree deals these quotas out: at each
node half of the blocks go left, and how many of them are of each source is drawn from the multivariate hypergeometric
distribution. Each leaf is an output shard. It draws its blocks from the source's permutation, disjoint from all other
shards, and orders them by a hash, which is the local shuffle.

The permutation is by hash, in two steps that need no sort of a whole source: hash ranges of about BIN_BLOCKS blocks,
whose totals are cumulated, then ranks within each range. Reruns agree, as all hashes come from ids, block numbers and
the seed.

Defined results: a null text or one without words has size 0 and takes 0; a null source is a source of its own, the last;
a null doc_id is an id like any other; repeated rows are mixed as rows of their own; an empty table gives an empty result;
when all sizes are 0 all targets are 0. Further columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import SPACE_WORD, durable, read_table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
BLOCK_WORDS = 256
BIN_BLOCKS = 4096
SHARD_BLOCKS = 16384
SEED = 20


def unit(*cols) -> Column:
    """A pseudo-random double in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(2**53))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, and rid, which tells repeated rows apart."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(SPACE_WORD)), F.lit(0)).cast("long").alias("size"), F.monotonically_increasing_id().alias("rid"))


def source_key(source: Column) -> Column:
    """A key that is never null: a null source differs from every name."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("-"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """skey, sidx, source_size, target: one row for each source.

    Resharing the excess of capped sources by weight, again and again, ends where every other source gets one and the same
    amount per unit of weight. Sources in the order of cap / weight reach their caps first, so that amount is found by
    cumulating over the sources in this order. The windows below run over sources, not over documents."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sidx", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("sidx") % len(weights) + 1).cast("int")))
    s = s.withColumns({"cap": most * F.col("source_size").cast("double"), "total": F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))})
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "sidx")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("k", F.row_number().over(order))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("k", "level"))).over(Window.partitionBy())["level"])
    target = F.coalesce(F.least(F.col("weight") * F.col("level"), F.col("cap")), F.col("cap"))
    return s.select(source_key(F.col("source")).alias("skey"), F.col("sidx").cast("long"), "source_size", target.alias("target"))


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _log_factorial(x: Column) -> Column:
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    d = x.cast("double")
    series = d * F.log(d) - d + 0.5 * F.log(2 * math.pi * d) + 1 / (12 * d) - 1 / (360 * d * d * d) + 1 / (1260 * d * d * d * d * d)
    return F.when(x < 16, F.element_at(small, (F.greatest(x, F.lit(0)) + 1).cast("int"))).otherwise(series)


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` blocks out of `total` are among the `good` ones, by inversion of u. Weights are summed over ten
    standard deviations on both sides of the mode, beyond which doubles have nothing to add."""
    n, k, m = total.cast("double"), good.cast("double"), drawn.cast("double")
    mode = F.floor((m + 1) * (k + 1) / (n + 2))
    wide = F.ceil(10 * F.sqrt(F.greatest(m * (k / n) * (1 - k / n) * (n - m) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0))) + 10)
    low = F.greatest(F.lit(0), drawn + good - total, mode - wide).cast("long")
    high = F.least(drawn, good, mode + wide).cast("long")

    def weight(x):
        return -(_log_factorial(x) + _log_factorial(good - x) + _log_factorial(drawn - x) + _log_factorial(total - good - drawn + x))

    def pick(w):
        whole = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
        zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("at"))
        return _let(whole, lambda t: F.aggregate(w, zero, lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["at"] + (a["sum"] + x < u * t).cast("long")).alias("at")))["at"])

    logs = _let(weight(F.greatest(low, F.least(high, mode.cast("long")))), lambda top: F.transform(F.sequence(low, high), lambda x: F.exp(weight(x) - top)))
    return F.when((drawn <= 0) | (good <= 0), F.lit(0).cast("long")).when(good >= total, drawn).when(drawn >= total, good).otherwise(F.least(high, low + _let(logs, pick)))


def split_node(node: Column, quotas: Column, seed: int) -> Column:
    """How many blocks of each source go left, when half of the node's blocks do: the sources one after the other."""
    whole = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)
    start = F.struct(F.array().cast("array<bigint>").alias("left"), whole.alias("rest"), F.floor(whole / 2).cast("long").alias("room"))

    def step(a, q):
        u = unit(F.lit(seed), node, F.size(a["left"]))
        return _let(hypergeometric(a["rest"], q, a["room"], u), lambda x: F.struct(F.array_append(a["left"], x).alias("left"), (a["rest"] - q).alias("rest"), (a["room"] - x).alias("room")))

    return F.aggregate(quotas, start, step)["left"]


def shard_quotas(quotas: DataFrame, depth: int, seed: int = SEED) -> DataFrame:
    """quotas(sidx, quota) -> shard, sidx, quota for 2^depth shards."""
    nodes = quotas.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("sidx", "quota"))), lambda x: x["quota"]).alias("q")).select(F.lit(1).cast("long").alias("node"), "q")
    for _ in range(depth):
        nodes = nodes.withColumn("left", split_node(F.col("node"), F.col("q"), seed))
        left = F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q"))
        right = F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("q", "left", lambda a, b: a - b).alias("q"))
        # A level at a time, as the plan of all levels would be large for the driver.
        nodes = durable(nodes.select(F.explode(F.array(left, right)).alias("x")).select("x.*"), "nodes")
    return nodes.select((F.col("node") - 2**depth).alias("shard"), F.posexplode("q").alias("sidx", "quota")).withColumn("sidx", F.col("sidx").cast("long"))


def ranked_blocks(sizes: DataFrame, sources: DataFrame, block_words: int, bin_blocks: int, seed: int) -> DataFrame:
    """Every block once, with its place in its source's permutation (rank, from 0) and the words before it there."""
    n = F.ceil(F.col("size") / block_words)
    b = sizes.where("size > 0").select("rid", "doc_id", "size", source_key(F.col("source")).alias("skey"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block"))
    b = b.withColumn("words", F.least(F.lit(block_words), F.col("size") - F.col("block") * block_words).cast("long"))
    b = b.withColumns({"h": F.xxhash64(F.lit(seed), "doc_id", "block", "size"), "at": unit(F.lit(seed), "doc_id", "block", "size")})
    bins = F.greatest(F.lit(1), F.ceil(F.col("source_size") / (block_words * bin_blocks)))
    b = b.join(sources.select("skey", "source_size"), "skey").withColumn("bin", F.floor(F.col("at") * bins)).drop("source_size", "at", "size")
    running = Window.partitionBy("skey").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = b.groupBy("skey", "bin").agg(F.sum("words").alias("w"), F.count("*").alias("n"))
    starts = totals.select("skey", "bin", F.coalesce(F.sum("w").over(running), F.lit(0)).alias("w0"), F.coalesce(F.sum("n").over(running), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("skey", "bin").orderBy("h", "rid", "block")
    b = b.withColumns({"r": F.row_number().over(inside) - 1, "w": F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")})
    return b.join(starts, ["skey", "bin"]).select("rid", "doc_id", "skey", "block", "words", (F.col("n0") + F.col("r")).alias("rank"), (F.col("w0") + F.col("w")).alias("before"))


def mix(sizes: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS, bin_blocks: int = BIN_BLOCKS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """The mix: one row for each drawn copy of a block: rid, doc_id, block, copy, words (how many of the block's first words
    are taken), shard, and place, by which the shard is to be sorted.

    sizes: what sized() gives, written down; sources: what targets() gives, written down."""
    ranked = durable(ranked_blocks(sizes, sources, block_words, bin_blocks, seed), "ranked")
    whole = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).cast("long")
    plan = sources.select("skey", "sidx", whole.alias("whole"), (F.round("target").cast("long") - whole * F.col("source_size")).alias("extra"))
    per = ranked.join(plan, "skey").groupBy("skey", "sidx", "whole", "extra").agg(F.count("*").alias("blocks"), F.sum((F.col("before") < F.col("extra")).cast("long")).alias("partial"))
    plan = durable(per.withColumn("quota", F.col("whole") * F.col("blocks") + F.col("partial")), "quotas")
    total = plan.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    depth = max(0, math.ceil(math.log2(max(1, total / shard_blocks))))
    leaves = durable(shard_quotas(plan.select("sidx", "quota"), depth, seed), "shards") if total else None
    if leaves is None:
        return ranked.select("rid", "doc_id", "block", F.lit(0).alias("copy"), "words", F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("place")).where("false")
    # Sources' indices may have gaps: those without words have no quota.
    dense = plan.select("skey", "quota", (F.row_number().over(Window.orderBy("sidx")) - 1).cast("long").alias("sidx"))
    cell = F.greatest(F.lit(1), F.floor(F.col("source_quota") / 2**depth))
    ends = leaves.join(dense.withColumnRenamed("quota", "source_quota"), "sidx").withColumn("end", F.sum("quota").over(Window.partitionBy("sidx").orderBy("shard")))
    spans = ends.where("quota > 0").select("skey", "shard", (F.col("end") - F.col("quota")).alias("start"), "end", cell.alias("cell"))
    spans = spans.withColumn("at", F.explode(F.sequence(F.floor(F.col("start") / F.col("cell")), F.floor((F.col("end") - 1) / F.col("cell")))))
    copies = F.sequence(F.lit(0).cast("long"), F.col("whole") - F.when(F.col("before") < F.col("extra"), 0).otherwise(1))
    width = plan.select("skey", "whole", "extra", "blocks", F.greatest(F.lit(1), F.floor(F.col("quota") / 2**depth)).alias("width"))
    drawn = ranked.join(width, "skey").where((F.col("whole") > 0) | (F.col("before") < F.col("extra"))).withColumn("copy", F.explode(copies))
    taken = F.when(F.col("copy") < F.col("whole"), F.col("words")).otherwise(F.least(F.col("words"), F.col("extra") - F.col("before")))
    drawn = drawn.withColumns({"words": taken, "position": F.col("copy") * F.col("blocks") + F.col("rank")}).withColumn("at", F.floor(F.col("position") / F.col("width")))
    found = drawn.join(spans.drop("cell"), ["skey", "at"]).where("position >= start and position < end")
    return found.select("rid", "doc_id", "block", "copy", "words", "shard", F.xxhash64(F.lit(seed + 1), "shard", "doc_id", "block", "copy").alias("place"))


def mixed(docs: DataFrame, **params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, sources, mix) of documents."""
    sizes = durable(sized(docs), "sizes")
    sources = durable(targets(sizes), "sources")
    return sizes, sources, mix(sizes, sources, **params)


def report(docs: DataFrame, **params) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, and n_shards, the shards that its words go to."""
    sizes, sources, drawn = mixed(docs, **params)
    per = drawn.groupBy("rid").agg(F.sum("words").alias("taken"), F.countDistinct("shard").alias("n_shards"))
    out = sizes.withColumn("skey", source_key(F.col("source"))).join(sources, "skey").join(per, "rid", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("n_shards", F.lit(0)).alias("n_shards"))


def block_texts(docs: DataFrame, drawn: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The text of each drawn block, shard by shard in the shuffled order; doc_id must tell the documents apart."""
    words = F.slice(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.col("block").cast("int") * block_words + 1, F.col("words").cast("int"))
    out = drawn.join(docs.select("doc_id", "text"), "doc_id").select("shard", "place", "doc_id", "block", "copy", F.array_join(words, " ").alias("text"))
    return out.repartition("shard").sortWithinPartitions("shard", "place")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read_table(spark, sf_dir, "documents"))
