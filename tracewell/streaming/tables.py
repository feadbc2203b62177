"""Tables that streams keep by key: rows in buckets of the key's hash, of which a batch rewrites only those it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.operators.stores import latest, upsert


class KeyedTable:
    """Rows by key under path/rows/version=V/_bucket=B. A manifest for each version says which version of each bucket counts; it
    is written last, so a batch that fails leaves the table as it was, and one that is run again changes nothing."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _committed(self, before: int | None = None) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        done = [s.getPath() for s in fs.listStatus(at) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        found = sorted(int(p.getName().removeprefix("version=")) for p in done)
        return [v for v in found if before is None or v < before]

    def versions(self, before: int | None = None) -> dict[int, int]:
        """Which version of each bucket counts, as of the newest version or the newest before a batch's own."""
        found = self._committed(before)
        rows = self.spark.read.parquet(f"{self.path}/manifests/version={found[-1]}").collect() if found else []
        return {r["bucket"]: r["version"] for r in rows}

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The table, or some of its buckets; None while it is empty."""
        parts = [f"{self.path}/rows/version={v}/_bucket={b}" for b, v in sorted(self.versions(before).items()) if buckets is None or b in buckets]
        return self.spark.read.parquet(*parts) if parts else None

    def merge(self, new: DataFrame, number: int, *ties: str) -> None:
        """Puts a batch's rows in place of those of the same key; of several new rows of a key the one that is last by `ties`."""
        if number in self._committed():
            return
        new = latest(new, self.key, *[F.desc_nulls_last(t) for t in ties or self.key]).withColumn("_bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")).persist()
        try:
            touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # `buckets` of them at most
            if not touched:
                return
            old = self.read(number, touched)
            merged = new if old is None else upsert(old.withColumn("_bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")), new, self.key, *ties)
            merged.write.partitionBy("_bucket").mode("overwrite").parquet(f"{self.path}/rows/version={number}")
            now = self.versions(number) | dict.fromkeys(touched, number)
            self.spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/version={number}")
        finally:
            new.unpersist()


def upsert_stream(rows: DataFrame, table: KeyedTable, ties: list[str], checkpoint: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    """Feeds a keyed table batch by batch. In update mode an aggregate is sent again whenever it changes, and the latest wins."""
    writer = rows.writeStream.foreachBatch(lambda batch, number: table.merge(batch, number, *ties)).outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
