"""A folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, one in the warehouse, or a temporary one when everything runs in one process."""
    if folder := spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tracewell.core.dir", None):
        return folder
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        folder = "file://" + tempfile.mkdtemp(prefix="spark-tracewell-")
    else:
        folder = spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    spark.conf.set("tracewell.core.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tracewell-{name}-{uuid.uuid4().hex}"
