"""The registry of queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.dims import RATES, rates
from tracewell.sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The relations that queries read, made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def ev(self) -> DataFrame:
        return adapters.events(self.spark, self.sf_dir)

    @cached_property
    def talk(self) -> DataFrame:
        return adapters.talk(self.spark, self.sf_dir)

    @cached_property
    def rates(self) -> DataFrame:
        return rates(self.spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


_RATES = "rates(rate_key, i, o) AS (VALUES " + ", ".join(f"('{k}', CAST({i} AS DOUBLE), CAST({o} AS DOUBLE))" for k, (i, o) in RATES.items()) + ")"


def query(name: str, sql: str | None = None, dates: tuple[str, ...] = ()):
    """Registers a query over Tables. sql: DuckDB's equivalent, over ev, talk and rates (common table expressions put in
    front of it) and the tables. dates: columns that are given as text, as engines show dates differently."""

    def register(make: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir)).withColumns({c: F.col(c).cast("string") for c in dates})
        if sql:
            body = sql.strip()
            joint = ", " + body[5:] if body.upper().startswith("WITH ") else " " + body
            whole = f"WITH {adapters.DUCK_PREFIX}, {_RATES}{joint}"
            shown = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
            ORACLES[name] = f"SELECT * REPLACE ({shown}) FROM ({whole}) AS q" if dates else whole
        return make

    return register
