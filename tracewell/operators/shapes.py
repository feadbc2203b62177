"""Values and tables of unknown or unlike shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values that count as absent, as JSON shows them.
EMPTY = ("", "0", "0.0", "false", "[]", "{}", "null")


def first_argument(arguments: Column, *keys: str) -> Column:
    """Of a call's arguments the first key's value that is there and not empty, as text. Arguments that are no JSON are one raw
    value, and stand for it; JSON that is no object has no keys."""
    parsed = F.try_parse_json(arguments)
    values = [F.get_json_object(arguments, f"$['{k}']") for k in keys]
    found = F.coalesce(*[F.when(~v.isin(*EMPTY), v) for v in values], F.lit(""))
    return F.when(arguments.isNull(), "").when(parsed.isNull(), arguments).otherwise(found)


def file_argument(arguments: Column) -> Column:
    return first_argument(arguments, "file_path", "path", "notebook_path")


def command_argument(arguments: Column) -> Column:
    return first_argument(arguments, "command", "cmd")


def common_type(types: list[T.DataType]) -> T.DataType:
    """The least type that holds all: whole numbers are long, other numbers with them double, text with anything is text. Types
    that have nothing in common but text become text."""
    kinds = {type(t): t for t in types if not isinstance(t, T.NullType)}
    if not kinds:
        return T.NullType()
    if all(isinstance(t, T.IntegralType) for t in kinds.values()):
        return T.LongType()
    if all(isinstance(t, T.NumericType) for t in kinds.values()):
        return T.DoubleType()
    if all(isinstance(t, (T.DateType, T.TimestampType)) for t in kinds.values()):
        return T.TimestampType() if len(kinds) > 1 else next(iter(kinds.values()))
    return next(iter(kinds.values())) if len({t.simpleString() for t in types if not isinstance(t, T.NullType)}) == 1 else T.StringType()


def widened_union(frames: list[DataFrame]) -> DataFrame:
    """All rows of tables that may lack columns or have them of different types, in the columns' order of appearance."""
    types: dict[str, list[T.DataType]] = {}
    for df in frames:
        for f in df.schema:
            types.setdefault(f.name, []).append(f.dataType)
    wide = {name: common_type(found) for name, found in types.items()}
    parts = [df.select(*[F.col(f"`{f.name}`").cast(wide[f.name]).alias(f.name) for f in df.schema]) for df in frames]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.select(*[F.col(f"`{name}`") for name in wide])


def incident_sessions(incidents: DataFrame, sessions: DataFrame, marks: DataFrame) -> DataFrame:
    """incidents(day, slug, polarity, session_refs), sessions(session_ref, ...), marks(session_ref, rating): one row for each
    session that a report names, whether it is known, and its mark. A report's reference is in the form of the event log's keys."""
    named = incidents.select("day", "slug", "polarity", F.explode("session_refs").alias("session_ref"))
    known = sessions.select("session_ref").distinct().withColumn("known", F.lit(True))
    return named.join(known, "session_ref", "left").join(marks.select("session_ref", "rating"), "session_ref", "left").select("day", "slug", "polarity", "session_ref", F.coalesce("known", F.lit(False)).alias("known"), "rating")


def stamped_test_sessions(ev: DataFrame, model: str = "faux") -> DataFrame:
    """Keys of sessions whose first creation record names the model of tests."""
    first = ev.where("kind = 'session_created'").groupBy("fleet", "session").agg(F.min_by(F.struct("model"), "id").alias("m"))
    return first.where(F.col("m.model") == model).select("fleet", "session")


def without_stamped(ev: DataFrame, model: str = "faux") -> DataFrame:
    return ev.join(stamped_test_sessions(ev, model), ["fleet", "session"], "left_anti")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with whether their session_ref has a label."""
    known = labels.select("session_ref").distinct().withColumn("_l", F.lit(True))
    return rows.join(known, "session_ref", "left").withColumn("labelled", F.col("_l").isNotNull()).drop("_l")
