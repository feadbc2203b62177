"""Toxicity: a factorization machine over hashed terms.

A document is the set of its words (runs of letters, lower-cased), hashed into BINS bins; each pair of bins has a learned
interaction, the product of two short vectors, so that an insult together with a mention of a group counts beyond the sum
of both. The machine is Spark ML's, trained over a bounded sample of labelled rows; scoring is one pass without a shuffle.

A bin is a feature if its label counts are far from chance, among all training rows (an insult), or among those that have, or
lack, a bin that tells of label 1 (a group's name, which tells in company only). If no bin tells anything in this way, all bins
that LEAST_DOCS rows have are features, so that pairs of words that tell nothing each are learned too. With all bins as
features always, noise is learned: on sf0.1 27 of 728 clean held-out texts were taken for toxic and 64 of 97 toxic ones found.

Defined results: a null or empty text, or one without letters, has no terms and gets the machine's bias as its score;
repeated rows get equal scores; a null doc_id is not held out and not learned from; labels that are null are not learned
from; with no labels, or labels of one class, every score is that class's (0 if there are none), and with no feature at all
the share of label 1; an empty table gives an empty result. Labels given twice for a document count twice.
"""

from __future__ import annotations

from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import bounded_sample, durable, held_out, learnable, read_table

BINS = 1 << 18
#: Labelled documents that the machine is fitted on, at most.
MAX_TRAIN = 20_000
#: How many standard deviations from chance a bin must be; rows that must have it where none is.
LEAST_Z, LEAST_DOCS = 5.0, 5
WORD = r"\p{L}+"


def terms(text: Column) -> Column:
    """The distinct hashed words of a text."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.array_distinct(F.transform(F.array_distinct(words), lambda w: F.pmod(F.xxhash64(w), F.lit(BINS)).cast("int")))


def _far(rows: DataFrame, least_z: float) -> dict[int, float]:
    """How far from chance (signed) the label counts of bins of rows(terms, label) are, where that is least_z or more."""
    n, ones = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or ones in (0, n):
        return {}
    p = ones / n
    bins = rows.select("label", F.explode("terms").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("ones"))
    z = (F.col("ones") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p) + 1)
    return {r["bin"]: r["z"] for r in bins.select("bin", z.alias("z")).where(F.abs("z") >= least_z).collect()}


def telling_bins(train: DataFrame, least_z: float = LEAST_Z, least_docs: int = LEAST_DOCS) -> list[int]:
    """The bins of train(terms, label) that are features; BINS bounds their number."""
    alone = _far(train, least_z)
    if toxic := [b for b, z in alone.items() if z > 0]:
        has = F.arrays_overlap("terms", F.array(*map(F.lit, toxic)))
        return sorted({*alone, *_far(train.where(has), least_z), *_far(train.where(~has), least_z)})
    if alone:
        return sorted(alone)
    bins = train.select(F.explode("terms").alias("bin")).groupBy("bin").count()
    return sorted(r["bin"] for r in bins.where(F.col("count") >= least_docs).collect())


def vectorizer(bins: list[int]) -> CountVectorizerModel:
    """From array<string> bins to a sparse 0/1 vector over the chosen ones; others count for nothing."""
    model = CountVectorizerModel.from_vocabulary([str(b) for b in bins], inputCol="bins", outputCol="features")
    return model.setBinary(True).setMinTF(1.0)


def fit(labelled: DataFrame, max_train: int = MAX_TRAIN, factors: int = 4, seed: int = 3):
    """labelled(doc_id, text, label) -> a function from a text column to a column of scores."""
    rows = bounded_sample(labelled.where("label is not null").select("doc_id", "text", F.col("label").cast("double").alias("label")), "doc_id", max_train)
    rows = durable(rows.select(terms(F.col("text")).alias("terms"), "label"), "toxic-train")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bins = telling_bins(rows) if len(counts) > 1 else []
    if not bins:
        rate = counts.get(1.0, 0) / max(1, sum(counts.values()))
        return lambda df, text="text": df.withColumn("score", F.lit(float(rate)))
    vectors = vectorizer(bins)
    train = vectors.transform(rows.select(F.col("terms").cast("array<string>").alias("bins"), "label").coalesce(2)).select("features", "label").persist()
    model = FMClassifier(factorSize=factors, maxIter=100, stepSize=0.05, regParam=1e-4, initStd=0.05, solver="adamW", seed=seed).fit(train)
    train.unpersist()

    def score(df: DataFrame, text: str = "text") -> DataFrame:
        out = model.transform(vectors.transform(df.withColumn("bins", terms(F.col(text)).cast("array<string>"))))
        return out.withColumn("score", vector_to_array("probability")[1]).drop("bins", "features", "rawPrediction", "probability", "prediction")

    return score


def labelled_docs(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, label of the documents that may be learned from."""
    rows = labels.where(learnable(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    return docs.select("doc_id", "text").join(rows, "doc_id")


def scored(docs: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """docs' doc_id with held_out, score and predicted."""
    out = model(docs.select("doc_id", "text"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """docs' rows that the model doesn't find toxic, with their own columns. Texts without a letter are kept."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("text", F.col("row.text"))
    wordless = ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    return model(packed).where((F.col("score") < threshold) | wordless).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return scored(docs, fit(labelled_docs(docs, read_table(spark, sf_dir, "labels"))))
