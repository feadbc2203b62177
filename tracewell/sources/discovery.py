"""Finding log files: listings as relations, and what paths tell of their files. Spark lists folders, in parallel when there are
many, and reads no file for it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.stores import latest

LISTING = "path string, mtime timestamp, size long"
#: What is no session of its own among transcripts, by its path.
BENCH, SUBAGENTS, HISTORY = "bench", "/subagents/", "history.jsonl"
PLANES = {"claude": "cc", "mu": "mu"}


def listed(spark: SparkSession, patterns: list[str] | str, names: str = "*.jsonl", deep: bool = True) -> DataFrame:
    """path, mtime, size of the files that the patterns match, each once; where there are none, an empty relation. Folders whose
    name begins with a dot are found if a pattern names them or a glob of it matches them."""
    patterns = [patterns] if isinstance(patterns, str) else patterns
    found = spark.createDataFrame([], LISTING)
    for pattern in patterns:
        try:
            files = spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", deep).load(pattern)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                continue
            raise
        found = found.unionByName(files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size")))
    return found.distinct()


def mu_logs(spark: SparkSession, root: str | None = None, sink: str | None = None) -> DataFrame:
    """Event logs of all machines, root/<machine>/events/<daemon>/<session>.jsonl; without a root the older layout, the folder
    `events` beside the sink: events/<daemon>/<session>.jsonl."""
    pattern = f"{root}/*/events/*/*.jsonl" if root else f"{sink.rsplit('/', 1)[0]}/events/*/*.jsonl"
    return listed(spark, pattern, deep=False)


def cc_logs(spark: SparkSession, folder: str | None) -> DataFrame:
    return listed(spark, f"{folder}/*/*.jsonl", deep=False) if folder else spark.createDataFrame([], LISTING)


def transcripts(spark: SparkSession, roots: list[str], subagents: bool = False, bench: bool = False) -> DataFrame:
    """Transcripts at any depth below the roots, without the prompt history and, unless asked for, subagents and benches."""
    return standalone(listed(spark, roots), subagents, bench)


def standalone(files: DataFrame, subagents: bool = False, bench: bool = False) -> DataFrame:
    """Of a listing the files that are sessions of their own."""
    path = F.col("path")
    keep = file_name(path) != HISTORY
    if not subagents:
        keep &= ~path.contains(SUBAGENTS)
    if not bench:
        keep &= ~path.contains(BENCH)
    return files.where(keep)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.jsonl$", "")


def with_layout(files: DataFrame, root: str) -> DataFrame:
    """Plane and host of files, the first two folders below the root; `?` where there is none."""
    rest = F.split(F.substring_index("path", root.rstrip("/") + "/", -1), "/")
    names = F.create_map(*[F.lit(x) for kv in PLANES.items() for x in kv])
    return files.withColumns({"plane": F.coalesce(F.element_at(names, rest[0]), rest[0]), "host": F.when(F.size(rest) > 1, rest[1]).otherwise("?")})


def sessions_of(files: DataFrame) -> DataFrame:
    """session_ref, path, mtime of transcripts: one file is one session. Of copies under several roots the newest counts, of
    equally new ones the last path."""
    refs = files.withColumn("session_ref", F.concat(F.lit("cc:"), stem(F.col("path"))))
    return latest(refs, ["session_ref"], F.desc("mtime"), F.desc("path"))


def daemon_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """session_ref and label (may be null) of a list of sessions: a line for each, the label after a tab; blank lines and those
    that begin with # are passed over."""
    line = F.trim("value")
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#"))
    parts = F.split(line, "\t")
    return rows.select(F.trim(parts[0]).alias("session_ref"), F.nullif(F.trim(F.get(parts, F.lit(1))), F.lit("")).alias("label"))
