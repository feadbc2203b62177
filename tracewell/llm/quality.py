"""Quality: a compression classifier.

Two zstandard dictionaries are trained, one on good and one on bad labelled texts. A text is compressed in pieces of
PIECE bytes with either, and the difference of the two sizes, over the text's length, tells which kind it is nearer to:
pieces keep the dictionaries in play over the whole of a long text. A logistic curve fitted on labelled rows turns the
difference into a calibrated score. Scoring is one pass over whole texts without a shuffle.

Fitting uses a sample of at most MAX_TRAIN labelled rows, half of them of each label. One half of the sample is for the
dictionaries: of each label as many rows, by hash, as hold MAX_BYTES of text, one at least, and all pieces of their whole
texts; a dictionary is DICTIONARY bytes, or a tenth of its pieces' bytes if that is less (LEAST at least). The other half's
whole texts are compressed in Spark tasks, and the curve is fitted on their differences, the quantity that scoring works out.

Defined results: a null or empty text has difference 0 and gets the curve's value there; repeated rows get equal scores; a
null doc_id is not held out and not learned from; null labels are not learned; with labels of one class only the score is
that class's for all (0.5 with no labels), and the share of label 1 where a class has too little text to train on; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import bounded_sample, durable, held_out, learnable, map_texts, read_table

PIECE = 1024
DICTIONARY = 64 * 1024
LEVEL = 3
#: The smallest dictionary that is trained, in bytes.
LEAST = 256
#: Labelled documents that dictionaries and curve are fitted on, at most, and bytes of text after which a dictionary takes no
#: more of them.
MAX_TRAIN = 4_000
MAX_BYTES = 32 << 20


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def pieces(raw: bytes, piece: int = PIECE) -> list[bytes]:
    return [raw[i : i + piece] for i in range(0, len(raw), piece)]


def within_bytes(rows: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """Of a sample's rows those of the least hash of the id, as many as it takes to hold `most` bytes of text."""
    h, total = F.xxhash64("doc_id", F.lit(31)), 0
    for r in rows.select(h.alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).orderBy("h").collect():  # MAX_TRAIN at most
        total += r["size"]
        if total >= most:
            return rows.where(h <= r["h"])
    return rows


def drawn_pieces(rows: DataFrame) -> list[bytes]:
    """All pieces of rows' whole texts, in order of hash."""

    def run(batches):
        for b in batches:
            found = [p for t in b.column("text") for p in pieces(as_bytes(t.as_py()))]
            hashes = [xxhash.xxh3_64_intdigest(p) >> 1 for p in found]
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(found, pa.binary())], names=["h", "piece"])

    found = within_bytes(rows).select("text").mapInArrow(run, "h long, piece binary").orderBy("h", "piece")
    return [bytes(r["piece"]) for r in found.collect()]


def dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes | None:
    """A dictionary trained on the samples; None if there is too little text for one."""
    try:
        return zstd.train_dictionary(max(LEAST, min(size, sum(map(len, samples)) // 10)), samples).as_bytes()
    except (zstd.ZstdError, ValueError):
        return None


class Difference:
    """How many bytes shorter than with the bad dictionary a text becomes with the good one, over its length."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = [zstd.ZstdCompressor(level=LEVEL, dict_data=zstd.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (good, bad)]

    def __call__(self, text: str | None) -> float:
        raw = as_bytes(text)
        if not raw:
            return 0.0
        good, bad = (sum(len(c.compress(p)) for p in pieces(raw)) for c in self.by)
        return (bad - good) / len(raw)


def differences(rows: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """rows' columns as a struct `row`, and each whole text's difference."""

    def make():
        diff = Difference(good, bad)
        return lambda texts: [[diff(t) for t in texts]]

    return map_texts(rows, "text", "difference double", make)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float, float]:
    """(scale, slope, intercept) of a curve fitted by Newton's method, with a weak prior on the slope."""
    scale = float(x.std()) or 1.0
    a, z = np.array([0.0, 0.0]), np.c_[x / scale, np.ones(len(x))]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        grad = z.T @ (y - p) - np.array([1e-2, 0]) * a
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + 1e-2 * np.eye(2), grad)
        a = a + np.clip(step, -2, 2)
    return scale, float(a[0]), float(a[1])


def fit(labelled: DataFrame, max_train: int = MAX_TRAIN) -> dict:
    """labelled(doc_id, text, label 0/1) -> the two dictionaries and the curve. The dictionaries and the curve learn from
    different rows, told apart by a hash of the id, so that the curve is fitted on texts that no dictionary has seen."""
    rows = labelled.where("label is not null").select("doc_id", "text", (F.col("label") != 0).cast("int").alias("label"))
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return {"constant": 0.5 if not n else float(1 in n)}
    constant = {"constant": n[1] / (n[0] + n[1])}
    sample = bounded_sample(rows.where("label = 0"), "doc_id", max_train // 2).unionByName(bounded_sample(rows.where("label = 1"), "doc_id", max_train // 2))
    for_curve = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(2)) == 1
    sample = durable(sample.withColumn("for_curve", for_curve), "quality-train")
    bad, good = (dictionary(drawn_pieces(sample.where(~F.col("for_curve") & (F.col("label") == y)))) for y in (0, 1))
    if not bad or not good:
        return constant
    points = differences(sample.where("for_curve").select("text", "label"), good, bad).select("row.label", "difference").collect()
    x, y = np.array([p["difference"] for p in points]), np.array([float(p["label"]) for p in points])
    if len(set(y)) < 2:
        return constant
    # Both classes were sampled alike: the intercept is moved to the classes' true shares.
    scale, slope, intercept = logistic(x, y)
    drawn = y.sum() / (len(y) - y.sum())
    return {"good": good, "bad": bad, "scale": scale, "slope": slope, "intercept": intercept + float(np.log(n[1] / n[0] / drawn))}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score, difference, from the whole text."""
    rows = docs.select("doc_id", "text")
    if "good" not in model:
        return rows.select("doc_id", F.lit(float(model["constant"])).alias("score"), F.lit(0.0).alias("difference"))
    out = differences(rows, model["good"], model["bad"]).select("row.doc_id", "difference")
    z = F.col("difference") / model["scale"] * model["slope"] + model["intercept"]
    return out.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).alias("score"), "difference")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(learnable(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    out = score(docs, fit(docs.join(labels, "doc_id")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
