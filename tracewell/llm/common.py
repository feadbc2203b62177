"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words as maximal runs of anything but ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of rows that map_texts gives to a function at once.
PIECE = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, UPPER, UPPER.lower())


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model learns from; a null id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """True for documents whose labels may be learned."""
    return F.crc32(doc_id.cast("string")) % 5 != 0


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one in the warehouse, or a
    temporary one when everything runs in this one process."""
    conf = spark.sparkContext.getConf()
    if folder := conf.get("spark.checkpoint.dir") or spark.conf.get("tracewell.shared.dir", None):
        return folder
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        folder = "file://" + tempfile.mkdtemp(prefix="spark-tracewell-")
    else:
        folder = spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    spark.conf.set("tracewell.shared.dir", folder)
    return folder


def durable(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tracewell-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, those with the least hash of `key`: for fitting classifiers on labelled rows only. Only hashes are
    sorted, and only those of a range that holds enough of them; the rows themselves pass through no one task."""
    n, h = df.count(), F.xxhash64(F.col(key), F.lit(17))
    if n <= most:
        return df
    hashes, share = df.select(h.alias("h")), min(1.0, 1.2 * most / n)
    found = hashes.where(F.col("h") < F.lit(int(-(2**63) + 2**64 * share))) if share < 0.6 else hashes
    least = [r["h"] for r in found.orderBy("h").limit(most).collect()]
    if len(least) < most:  # few keys, of many rows each: the range held too few
        least = [r["h"] for r in hashes.orderBy("h").limit(most).collect()]
    border = least[-1]
    return df.where(h < border).unionByName(df.where(h == border).limit(least.count(border)))


def map_texts(docs: DataFrame, column: str, ddl: str, make) -> DataFrame:
    """docs' columns as a struct `row`, and new columns (ddl). make() is called once in each task and gives a function from
    a list of texts to the new columns' values, a list each; a text is one row's whole `column`."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    new = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(new)

    def pieces(batches):
        """Batches of about PIECE bytes, so that what work() makes of a batch is bounded too."""
        for batch in batches:
            step = max(1, batch.num_rows * PIECE // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)

    def run(batches):
        work = make()
        for batch in pieces(batches):
            values = work(pa.RecordBatch.from_struct_array(batch.column(0)).column(column).to_pylist() if batch.num_rows else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, f.type) for v, f in zip(values, arrow, strict=True)]], names=["row", *arrow.names])

    return packed.mapInArrow(run, StructType([*packed.schema.fields, *new.fields]))
