"""Files for people and other programs: tables with tabs, and the artifact of the probe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

META = "r2 double, mae double, n_interactive long, n_unattended long, importances array<struct<feature: string, gain: double>>"
SESSIONS = "session_ref string, kind string, started string, window string, n_user long, pos long, neg long, net long, obs double, pred double, ending string, calls long, tool_calls long, cost double"
INTERACTIVE, UNATTENDED = "interactive", "unattended"


def write_tsv(df: DataFrame, path: str) -> None:
    """A header and a line for each row; tabs and line ends in texts become spaces, so that each row is one line.
    Null and the empty text are both written as nothing, and read as null."""
    flat = [F.regexp_replace(c, r"[\t\r\n]+", " ").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").options(sep="\t", header=True, quote="", escape="", emptyValue="").csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(sep="\t", header=True, quote="", escape="", emptyValue="").csv(path)


def write_probe(meta: DataFrame, sessions: DataFrame, path: str) -> None:
    """meta (one row) and sessions as JSON lines of pinned shape, beside each other: sessions are written by all tasks."""
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    sessions.write.mode("overwrite").json(f"{path}/sessions")


def read_probe(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(META).json(f"{path}/meta"), spark.read.schema(SESSIONS).json(f"{path}/sessions")


def probe_panels(sessions: DataFrame, tails: int = 12, worst: int = 15) -> DataFrame:
    """The artifact's lists: interactive sessions that were rosier than they read (unnoticed) and warmer (task_frust), by what
    was predicted less what was seen, and unattended ones of the least prediction; each with its rank. The limits are the feature."""
    resid = F.round(F.coalesce("pred", F.lit(0.0)) - F.coalesce("obs", F.lit(0.0)), 1)
    inter = sessions.where(F.col("kind") == INTERACTIVE).withColumn("resid", resid)
    alone = sessions.where(F.col("kind") == UNATTENDED).withColumn("resid", F.lit(None).cast("double"))

    def top(df: DataFrame, name: str, order, n: int) -> DataFrame:
        ranked = df.withColumns({"panel": F.lit(name), "_o": order}).orderBy("_o", "session_ref").limit(n)  # n rows: ranked in one task
        return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("panel").orderBy("_o", "session_ref")).cast("long")).drop("_o")

    rows = top(inter, "unnoticed", -F.col("resid"), tails).unionByName(top(inter, "task_frust", F.col("resid"), tails)).unionByName(top(alone, "unattended", F.coalesce("pred", F.lit(0.0)), worst))
    return rows.select("panel", "rank", "session_ref", "obs", "pred", "resid")


def probe_sessions(interactive: DataFrame, unattended: DataFrame) -> DataFrame:
    """Records of both kinds in the artifact's shape; what a kind lacks is null."""
    from pyspark.sql.types import StructType

    shape = StructType.fromDDL(SESSIONS)
    part = lambda df, kind: df.withColumn("kind", F.lit(kind)).select(*[(F.col(f.name) if f.name in df.columns or f.name == "kind" else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape])
    return part(interactive, INTERACTIVE).unionByName(part(unattended, UNATTENDED))
