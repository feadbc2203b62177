"""The marks inbox: files of marks, one JSON object a line, are folded into the store of marks and put into an archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.stores import mark_ref, rating
from tracewell.streaming.tables import KeyedTable

MARK = "task_id string, id string, rating string, note string, session_id string, daemon string, created_at_unix_ms long, session_ref string, ref string, broken string"
KEY = ["mark_id"]


def mark_lines(spark: SparkSession, inbox: str, archive: str | None = None, names: str = "*.jsonl", files_per_trigger: int = 1000) -> DataFrame:
    """Lines of the inbox's files as a stream. With an archive, files that were taken in are moved there; the archive must not
    lie in the inbox."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", names)
    if archive:
        lines = lines.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return lines.text(inbox).select(F.trim("value").alias("line"), F.col("_metadata.file_name").alias("file")).where("line != ''")


def parsed(lines: DataFrame) -> DataFrame:
    """Lines with their mark `m`; m.broken is set if a line is no JSON object."""
    return lines.withColumn("m", F.from_json("line", MARK, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}))


def marks(lines: DataFrame) -> DataFrame:
    """mark_id, rating, note, created_ms, session_ref of well-formed lines. A mark without an id is known by its line, so that
    the same line is the same mark when it comes again."""
    ok = parsed(lines).where("m.broken is null")
    ident = F.coalesce("m.task_id", "m.id", F.concat(F.lit("mark-"), F.substring(F.sha2("line", 256), 1, 16)))
    ref = mark_ref(F.coalesce("m.session_ref", "m.ref"), F.col("m.session_id"), F.col("m.daemon"))
    value = F.coalesce(F.col("m.rating"), F.lit("3"))
    return ok.select(ident.alias("mark_id"), rating(value).alias("rating"), F.coalesce("m.note", F.lit("")).alias("note"), F.col("m.created_at_unix_ms").alias("created_ms"), ref.alias("session_ref"), "file")


def broken_lines(lines: DataFrame) -> DataFrame:
    return parsed(lines).where("m.broken is not null").groupBy("file").agg(F.count("*").alias("broken"))


def ingest(spark: SparkSession, inbox: str, archive: str | None, store: KeyedTable, broken: KeyedTable, checkpoint: str, names: str = "*.jsonl") -> None:
    """Folds all new files into the store (the latest mark of an id counts) and keeps how many lines of each were no marks. A
    file is read once, a batch that fails is run again whole, and a run without new files changes nothing."""

    def fold(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            store.merge(marks(batch), number, "created_ms", "file", "note", "rating")
            broken.merge(broken_lines(batch), number)
        finally:
            batch.unpersist()

    stream = mark_lines(spark, inbox, archive, names)
    stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
