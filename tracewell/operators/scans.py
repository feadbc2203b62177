"""Scans of what operators and assistants say: frustration, sentiment and behaviour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import ANNOUNCE, CLAIM, NEGATIVE, POSITIVE, REDIRECT, ending, found_marks, has, marks, tool_of, verifies
from tracewell.operators.quantiles import by_metric, counted, quantiles, stacked
from tracewell.operators.sessions import KEY, session_ref

ZONE = "America/New_York"


def operator_messages(ev: DataFrame) -> DataFrame:
    """What the operator wrote, without what the harness put in."""
    return ev.where("kind = 'user_message' and meta is null")


def window_label(ts_ms: Column, daily: bool = False, zone: str = ZONE) -> Column:
    """The calendar window of a time, in a named zone: a weekend runs from Friday 18:00 to Monday 06:00 and is named by its
    Saturday, a weekday by its week's Monday; daily windows are days."""
    local = F.from_utc_timestamp(F.timestamp_millis(ts_ms), zone)
    day, hour, name = F.weekday(local), F.hour(local), lambda d: F.lower(F.date_format(d, "MMMdd"))
    weekend = ((day == 4) & (hour >= 18)) | (day >= 5) | ((day == 0) & (hour < 6))
    to_saturday = F.when(day == 4, 1).when(day == 6, -1).when(day == 0, -2).otherwise(0)
    date = F.to_date(local)
    by_week = F.when(weekend, F.concat(F.lit("W-"), name(F.date_add(date, to_saturday)))).otherwise(F.concat(F.lit("wd-"), name(F.date_sub(date, day))))
    label = F.lower(F.date_format(local, "E-MMMdd")) if daily else by_week
    return F.when(ts_ms.isNull(), "unknown-ts").otherwise(label)


def _talk(ev: DataFrame) -> DataFrame:
    text = F.coalesce("content", F.lit(""))
    return operator_messages(ev).select(*KEY, "id", "ts", text.alias("content"), marks(text, NEGATIVE).alias("neg"), marks(text, POSITIVE).alias("pos"))


def frustration(ev: DataFrame, least: int = 2) -> DataFrame:
    """Sessions of two or more operator messages: markers of annoyance, the first four of them, and how the session ended."""
    rows = _talk(ev).withColumn("found", found_marks(F.col("content"), NEGATIVE))
    per = rows.groupBy(*KEY).agg(
        F.count("*").alias("n_user"), F.sum("neg").alias("hits"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, 4).alias("m"),
        F.min_by(F.when(F.col("ts") != 0, F.col("ts")), F.when(F.col("ts") != 0, F.col("id"))).alias("first_ms"), F.max_by("content", "id").alias("last"),
    ).where(F.col("n_user") >= least)
    return per.select(session_ref(F.col("fleet"), F.col("session")).alias("session_ref"), "n_user", "hits", F.array_join("m", "|").alias("markers"), "first_ms", window_label(F.col("first_ms")).alias("window"), ending(F.col("last")).alias("ending"))


def frustration_windows(scan: DataFrame) -> DataFrame:
    return scan.groupBy("window").agg(
        F.count("*").alias("sessions"), F.count_if(F.col("hits") > 0).alias("with_hits"), F.sum("n_user").alias("n_user"), F.sum("hits").alias("hits"),
        F.min("first_ms").alias("first_ms"), (100 * F.sum("hits") / F.sum("n_user")).alias("per_100"),
    )


def frustration_signals(scan: DataFrame) -> DataFrame:
    """Sessions with markers, by severity."""
    severity = F.when((F.col("hits") >= 4) | (F.col("ending") == "ABRUPT+frustrated"), "high").when(F.col("hits") >= 2, "med").otherwise("low")
    return scan.where("hits > 0").select("session_ref", severity.alias("severity"), F.format_string("%d markers in %d messages", "hits", "n_user").alias("why"))


def sentiment(ev: DataFrame, least: int = 2) -> DataFrame:
    """Signed markers of each session: pleased less annoyed, and that as a rate per hundred messages."""
    per = _talk(ev).groupBy(*KEY).agg(F.count("*").alias("n_user"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.min("ts").alias("first_ms"), F.max_by("content", "id").alias("last")).where(F.col("n_user") >= least)
    net = F.col("pos") - F.col("neg")
    return per.select(session_ref(F.col("fleet"), F.col("session")).alias("session_ref"), "n_user", "pos", "neg", net.alias("net"), (100 * net / F.col("n_user")).alias("rate"), "first_ms", window_label(F.col("first_ms")).alias("window"), ending(F.col("last")).alias("ending"))


def sentiment_windows(scan: DataFrame) -> DataFrame:
    return scan.groupBy("window").agg(F.count("*").alias("sessions"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("net").alias("net"))


def turns(ev: DataFrame) -> DataFrame:
    """Messages with their segment: an operator's message and the assistant turns that follow it. Assistant turns before any
    message are segment 0."""
    rows = ev.where("kind = 'assistant_message_event' or (kind = 'user_message' and meta is null)").withColumn("user", F.col("kind") == "user_message")
    return rows.withColumn("segment", F.count_if("user").over(Window.partitionBy(*KEY).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)))


def behavior(ev: DataFrame, least: int = 2) -> DataFrame:
    """Whether assistants do what they say: claims with and without a tool, announcements that were acted on, and whether a
    redirect changed what tools were used."""
    text, user = F.coalesce("content", F.lit("")), F.col("user")
    rows = turns(ev).select(
        *KEY, "segment", user, (~user & has(text, CLAIM)).alias("claims"), (~user & has(text, ANNOUNCE)).alias("announces"), F.when(~user & F.col("tool_name").isNotNull(), tool_of(F.col("tool_name"))).alias("tool"),
        (~user & F.col("tool_name").isNotNull() & verifies(F.col("tool_name"), F.col("command"))).alias("verify"), (user & has(F.left(text, F.lit(200)), REDIRECT)).alias("redirect"),
    )
    segments = rows.groupBy(*KEY, "segment").agg(
        F.count_if("user").alias("n_user"), F.count_if(~user).alias("n_asst"), F.count_if("claims").alias("claims"), F.count_if("announces").alias("announces"), F.max("verify").alias("verify"),
        F.max("redirect").alias("redirect"), F.array_sort(F.collect_set("tool")).alias("tools"),
    )
    before = F.lag("tools").over(Window.partitionBy(*KEY).orderBy("segment"))
    segments = segments.withColumns({"before": before, "with_tool": F.size("tools") > 0})
    asked = F.col("redirect") & (F.col("n_asst") > 0)
    same = F.col("before").isNotNull() & (F.col("before") == F.col("tools"))
    out = segments.groupBy(*KEY).agg(
        F.sum("n_user").alias("n_user"), F.sum("n_asst").alias("n_asst"), F.sum(F.when(F.col("verify"), F.col("claims")).otherwise(0)).alias("claim_then_verify"),
        F.sum(F.when(~F.col("with_tool"), F.col("claims")).otherwise(0)).alias("claim_no_tool"), F.sum(F.when(F.col("with_tool"), F.col("announces")).otherwise(0)).alias("announce_then_act"),
        F.count_if(asked & ~same).alias("correction_change"), F.count_if(asked & same).alias("correction_same"),
    ).where(F.col("n_user") >= least)
    changed, kept = F.col("correction_change"), F.col("correction_same")
    return out.withColumn("release_rate", F.when(changed + kept > 0, changed / (changed + kept)))


def behavior_totals(scan: DataFrame) -> DataFrame:
    return scan.groupBy("fleet").agg(F.count("*").alias("sessions"), F.avg("release_rate").alias("mean_release"), (100 * F.sum("claim_no_tool") / F.sum("n_user")).alias("claims_per_100"))


def halves(ev: DataFrame, least: int = 6) -> DataFrame:
    """Marker rates of the first and second half of each session's operator messages."""
    order = Window.partitionBy(*KEY).orderBy("id")
    rows = _talk(ev).withColumns({"i": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy(*KEY))}).where(F.col("n") >= least)
    first = F.col("i") <= F.floor(F.col("n") / 2)
    per = rows.groupBy(*KEY).agg(F.avg(F.when(first, F.col("neg"))).alias("a"), F.avg(F.when(~first, F.col("neg"))).alias("b"))
    counts = counted(stacked(per, [], {"a": F.col("a"), "b": F.col("b")}), ["metric"])
    middle = by_metric(quantiles(counts, ["metric"], [0.5]), [], {"a": ["first_median"], "b": ["second_median"]})
    one = F.lit(1).alias("one")
    whole = per.agg(F.count("*").alias("sessions"), F.count_if(F.col("b") > F.col("a")).alias("rising"))
    return whole.select("*", one).join(middle.select("*", one), "one").select("sessions", "first_median", "second_median", "rising")  # one row each


def marker_rates(ev: DataFrame) -> DataFrame:
    """Markers per thousand operator messages of each fleet, and of bands by number of messages."""
    per = _talk(ev).groupBy(*KEY).agg(F.count("*").alias("n"), F.sum("neg").alias("hits"))
    band = F.when(F.col("n") < 3, "S").when(F.col("n") < 6, "M").otherwise("L")
    return per.groupBy("fleet", band.alias("band")).agg(F.count("*").alias("sessions"), F.count_if(F.col("hits") > 0).alias("present"), (1000 * F.sum("hits") / F.sum("n")).alias("per_1000"))


def overall_rates(ev: DataFrame) -> DataFrame:
    """Markers per thousand operator messages of each fleet, and of all (a fleet of null)."""
    per = _talk(ev).groupBy(*KEY).agg(F.count("*").alias("n"), F.sum("neg").alias("hits"))
    return per.rollup("fleet").agg(
        F.count("*").alias("sessions"), F.count_if(F.col("hits") > 0).alias("present"), F.sum("hits").alias("hits"), F.sum("n").alias("messages"), (1000 * F.sum("hits") / F.sum("n")).alias("per_1000"),
    )


def stratified_sample(ev: DataFrame, most: int = 20) -> DataFrame:
    """A fixed number of sessions of each fleet and size band, by the md5 of their names. The limit is the feature."""
    per = operator_messages(ev).groupBy(*KEY).agg(F.count("*").alias("n"))
    band = F.when(F.col("n") < 3, "S").when(F.col("n") < 6, "M").otherwise("L")
    ranked = per.withColumn("band", band).withColumn("rank", F.row_number().over(Window.partitionBy("fleet", "band").orderBy(F.md5("session"), "session")).cast("long"))
    return ranked.where(F.col("rank") <= most)


#: How the rows of each scan are listed.
ORDERS = {
    "frustration": lambda: [F.desc(F.col("hits") / F.greatest("n_user", F.lit(1))), F.desc("hits"), F.asc("session_ref")],
    "sentiment": lambda: [F.asc("rate"), F.asc("net"), F.asc("session_ref")],
    "behavior": lambda: [F.desc("claim_no_tool"), F.asc("session_ref")],
}


def in_order(scan: DataFrame, kind: str) -> DataFrame:
    return scan.orderBy(*ORDERS[kind]())
