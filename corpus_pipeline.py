"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, repeated passages are cut, documents
with benchmark passages go, and what is left is mixed to the sources' target weights.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and calls one operator of tracewell.llm; what
those define for nulls, ties, repeated rows and empty tables holds here too. All stages but the last return the columns of
documents; the last returns a row for each document with what the mix takes of it.

A null or empty text is not toxic and is kept by the first stage, whatever the base rate; empty texts are near-duplicates of
each other (no shingles), so one of them stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import decontaminate, mixing, near_copies, simhash, suffix_dedup, toxicity
from tracewell.llm.common import read_table, shared_folder


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of 0.5 or more. Labels are learned from all of the table documents, so that the
    stage's model doesn't depend on what it is given."""
    source = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.labelled_docs(source, read_table(spark, sf_dir, "labels")))
    return toxicity.clean(docs, model)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies have a Jaccard similarity of 0.8 or more in shingles of five words. Candidates are SimHash fingerprints of those
    shingles within four bits, and for texts farther apart bands of minimum hashes; op2's own measure is that query's alone."""
    return simhash.deduplicated(docs, near_copies.grouped)


def repeats_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.report(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("simhash_dedup", near_duplicates_out),
    ("suffix_dedup", repeats_cut),
    ("decontaminate", benchmark_out),
    ("mix", mixed),
]

#: The first stage's model and the second's components are not SQL; see tests/llm for the version that this is tested against.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
