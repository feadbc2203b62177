"""Reports that join several operators: transcripts, attention, identities, findings, incidents, gaps, bands and billing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import NEGATIVE, marks, severity_rank
from tracewell.operators.scans import operator_messages, window_label
from tracewell.operators.sessions import KEY, session_ref

#: List prices of billed usage by model family, USD per million tokens: input, output.
FAMILY_PRICES = {"opus": (5.0, 25.0), "sonnet": (3.0, 15.0), "haiku": (1.0, 5.0)}
#: Fixed value: how sessions are referred to.
REFERENCE = r"\b(cc:[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}|mu:[A-Za-z0-9_]+[:/][A-Za-z0-9_.-]+)"
FINDING = r"^\s*\[(\w+)\]\s+(\S+)\s+@event\s+(\d+):\s*(.*)$"


def preview(text: Column, most: int = 96) -> Column:
    """The first line that isn't blank, with white space made single, cut to `most` characters."""
    line = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?m)^\s*(\S.*)$", 1)
    short = F.trim(F.regexp_replace(line, r"\s+", " "))
    return F.when(F.length(short) > most, F.concat(F.rtrim(F.left(short, F.lit(most - 1))), F.lit("…"))).otherwise(short)


def transcript_lines(ev: DataFrame, cap: int = 1200) -> DataFrame:
    """A numbered line for each turn of a session; blank ones are left out. Rows, not one text a session: sessions may be of any size."""
    role = F.when(F.col("kind") == "user_message", F.when(F.col("meta").isNotNull(), "SYSTEM").otherwise("USER")).otherwise("ASSISTANT")
    rows = ev.where("kind in ('user_message', 'assistant_message_event') and trim(coalesce(content, '')) <> ''")
    n = F.row_number().over(Window.partitionBy(*KEY).orderBy("id"))
    return rows.select(*KEY, n.cast("long").alias("n"), F.format_string("[%03d] %s: %s", n, role, F.left("content", F.lit(cap))).alias("line"), preview(F.col("content")).alias("preview"))


def changed_transcripts(ev: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sessions whose last event is newer than the manifest's (session_ref, last_id): those to be written again."""
    now = ev.groupBy(session_ref(F.col("fleet"), F.col("session")).alias("session_ref")).agg(F.max("id").alias("last_id"))
    return now.join(manifest.select("session_ref", F.col("last_id").alias("_had")), "session_ref", "left").where("_had is null or last_id > _had").drop("_had")


def attention(*sources: DataFrame) -> DataFrame:
    """Sources of (session_ref, source): how many different ones point to a session."""
    return reduce(DataFrame.unionByName, [s.select("session_ref", "source") for s in sources]).groupBy("session_ref").agg(F.countDistinct("source").alias("sources"), F.count("*").alias("signals"))


def short_id(fleet: Column, key: Column) -> Column:
    """A display id: 32 bits of the natural key's hash, as 16 collide."""
    return F.concat(fleet, F.lit("·"), F.left(F.sha2(key, 256), F.lit(8)))


def identities(session_rows: DataFrame) -> DataFrame:
    """session_rows(fleet, daemon, session_id, session, started_ms) -> alias, display_id, session_ref: the newest session that an
    alias stands for."""
    ref = session_ref(F.col("fleet"), F.col("session"))
    rows = session_rows.withColumns({"session_ref": ref, "display_id": short_id(F.col("fleet"), F.col("session"))})
    alias = F.explode(F.array_distinct(F.array("display_id", "session_ref", "session", "session_id", "daemon")))
    return rows.select(alias.alias("alias"), "display_id", "session_ref", "started_ms").groupBy("alias").agg(F.max_by(F.struct("display_id", "session_ref"), F.struct("started_ms", "session_ref")).alias("x")).select("alias", "x.*")


def parsed_findings(lines: DataFrame) -> DataFrame:
    """lines(session_ref, line) -> severity, invariant, event_id and detail of those that are findings."""
    part = lambda i: F.regexp_extract("line", FINDING, i)
    return lines.where(F.col("line").rlike(FINDING)).select("session_ref", F.lower(part(1)).alias("severity"), part(2).alias("invariant"), part(3).cast("long").alias("event_id"), part(4).alias("detail"))


def findings_by_day(findings: DataFrame) -> DataFrame:
    """Findings(day, severity) of each day by severity."""
    rank = severity_rank(F.col("severity"))
    return findings.groupBy("day").agg(*[F.count_if(rank == i).alias(n) for i, n in enumerate(("high", "med", "low", "other"))])


def incidents(files: DataFrame, polarity: dict[str, str]) -> DataFrame:
    """files(path, text) of markdown reports named prefix-YYYY-MM-DD-slug.md -> date, title, polarity, slug and session
    references; names without a date, or with a prefix that stands for nothing, are left out."""
    name = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    part = lambda i: F.regexp_extract(name, r"^([a-z]+)-(\d{4}-\d{2}-\d{2})-(.+)$", i)
    kinds = F.create_map(*[F.lit(x) for kv in polarity.items() for x in kv])
    refs = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(1)), lambda r: F.when(r.startswith("mu:"), F.translate(F.rtrim(r, F.lit(".")), "/", ":")).otherwise(r)))
    out = files.select(part(2).try_cast("date").alias("day"), F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1).alias("title"), F.element_at(kinds, part(1)).alias("polarity"), part(1).alias("kind"), part(3).alias("slug"), refs.alias("session_refs"), "path")
    return out.where("day is not null and polarity is not null")


def billed_usage(days: DataFrame) -> DataFrame:
    """days(starting_at, results array of model, tokens and amount in cents as text) -> day, model, tokens, list price and billed USD."""
    r = days.select(F.to_date(F.left("starting_at", F.lit(10))).alias("day"), F.explode("results").alias("r")).select("day", "r.*")
    family = lambda i: F.coalesce(*[F.when(F.lower("model").contains(k), F.lit(v[i])) for k, v in FAMILY_PRICES.items()], F.lit(0.0))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    price = (n("uncached_input_tokens") + 1.25 * n("write_5m") + 2.0 * n("write_1h") + 0.1 * n("cache_read_input_tokens")) * family(0) + n("output_tokens") * family(1)
    return r.withColumns({"write_5m": F.col("cache_creation.ephemeral_5m_input_tokens"), "write_1h": F.col("cache_creation.ephemeral_1h_input_tokens")}).groupBy("day", "model").agg(
        F.sum(n("uncached_input_tokens")).alias("uncached_input"), F.sum(n("output_tokens")).alias("output"), F.sum(price / 1e6).alias("list_usd"), F.sum(F.coalesce(F.col("amount").try_cast("double"), F.lit(0.0)) / 100).alias("billed_usd"),
    )


def reconciled(billed: DataFrame, computed: DataFrame) -> DataFrame:
    """Billed and computed cost of each day: (day, billed_usd) and (day, cost)."""
    both = billed.groupBy("day").agg(F.sum("billed_usd").alias("billed_usd")).join(computed.groupBy("day").agg(F.sum("cost").alias("cost")), "day", "full")
    return both.select("day", F.coalesce("billed_usd", F.lit(0.0)).alias("billed_usd"), F.coalesce("cost", F.lit(0.0)).alias("cost"))


def long_gaps(ev: DataFrame, hours: float = 3.0) -> DataFrame:
    """Pauses of a session's operator of `hours` or more: how long, when they began, and markers in the two messages before and the one after."""
    order = Window.partitionBy(*KEY).orderBy("id")
    rows = operator_messages(ev).select(*KEY, "id", "ts", marks(F.coalesce("content", F.lit("")), NEGATIVE).alias("hits"))
    rows = rows.withColumns({"before_ms": F.lag("ts").over(order), "before": F.sum("hits").over(order.rowsBetween(-2, -1))})
    gap = (F.col("ts") - F.col("before_ms")) / 3_600_000.0
    return rows.where(gap >= hours).select(*KEY, "id", gap.alias("hours"), F.hour(F.timestamp_millis("before_ms")).cast("long").alias("left_hour"), F.coalesce("before", F.lit(0)).alias("hits_before"), F.col("hits").alias("hits_after"))


def leaving_hours(gaps: DataFrame) -> DataFrame:
    """The hour or hours at which most pauses began."""
    n = gaps.groupBy("left_hour").agg(F.count("*").alias("n"))
    return n.join(n.agg(F.max("n").alias("n")), "n").select("left_hour", "n")


def band_density(ev: DataFrame) -> DataFrame:
    """Messages, tools and markers of sessions by their number of tool calls."""
    talk = (F.col("kind") == "user_message") & F.col("meta").isNull()
    per = ev.groupBy(*KEY).agg(F.count_if(talk).alias("messages"), F.count_if(F.col("kind") == "tool_call").alias("tools"), F.sum(F.when(talk, marks(F.coalesce("content", F.lit("")), NEGATIVE)).otherwise(0)).alias("hits"))
    band = F.when(F.col("tools") < 2, "S").when(F.col("tools") < 5, "M").otherwise("L")
    return per.groupBy(band.alias("band")).agg(F.count("*").alias("sessions"), F.avg("messages").alias("messages"), F.avg("tools").alias("tools"), F.try_divide(F.sum("messages").cast("double"), F.sum("tools")).alias("messages_per_tool"), F.sum("hits").alias("hits"))


def maturity(ev: DataFrame) -> DataFrame:
    """Sessions by the week of their first event, and how many of them have compaction, workers, recall and marks."""
    kinds = {"compaction": "compaction_assembly", "workers": "worker_spawned", "recall": "recall_provenance", "marks": "operator_mark"}
    per = ev.groupBy(*KEY).agg(F.min("ts").alias("first"), *[F.max(F.col("kind") == k).alias(n) for n, k in kinds.items()])
    return per.groupBy(F.to_date(F.date_trunc("week", F.timestamp_millis("first"))).alias("week")).agg(F.count("*").alias("sessions"), *[F.count_if(n).alias(n) for n in kinds])


def explicit_windows(ev: DataFrame, windows: list[tuple[str, int, int]]) -> DataFrame:
    """Sessions by window: the first of the given (label, from, to) that holds the session's first event, else its calendar window."""
    per = ev.groupBy(*KEY).agg(F.min("ts").alias("first_ms"))
    label = F.coalesce(*[F.when(F.col("first_ms").between(a, b), F.lit(n)) for n, a, b in windows], window_label(F.col("first_ms")))
    return per.groupBy(label.alias("window")).agg(F.count("*").alias("sessions"), F.min("first_ms").alias("first_ms")).orderBy("first_ms", "window")


def parsed_verdict(reply: Column, schema: str = "occurred boolean, severity string, confidence string, summary string") -> Column:
    """What stands between a reply's outermost braces."""
    return F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), schema)


def gap_messages(ev: DataFrame, hours: float = 3.0, cap: int = 400) -> DataFrame:
    """The messages around a pause of `hours` or more: the two before it, oldest first, and the one after it."""
    order = Window.partitionBy(*KEY).orderBy("id")
    text = F.left(F.coalesce("content", F.lit("")), F.lit(cap))
    rows = operator_messages(ev).select(*KEY, "id", "ts", text.alias("after"))
    rows = rows.withColumns({"left_ms": F.lag("ts").over(order), "before_1": F.lag("after", 2).over(order), "before_2": F.lag("after").over(order)})
    gap = (F.col("ts") - F.col("left_ms")) / 3_600_000.0
    return rows.where(gap >= hours).select(*KEY, "id", gap.alias("hours"), "before_1", "before_2", "after")


def context_bands(ev: DataFrame, bounds: tuple[int, int] = (2_000, 4_000)) -> DataFrame:
    """Markers of operator messages by bands of a session's largest context; sessions without one are band `?`."""
    talk = (F.col("kind") == "user_message") & F.col("meta").isNull()
    hits = F.when(talk, marks(F.coalesce("content", F.lit("")), NEGATIVE)).otherwise(0)
    per = ev.groupBy(*KEY).agg(F.count_if(talk).alias("messages"), F.sum(hits).alias("hits"), F.max("token_count").alias("context")).where("messages > 0")
    band = F.when(F.col("context").isNull(), "?").when(F.col("context") < bounds[0], "S").when(F.col("context") < bounds[1], "M").otherwise("L")
    return per.groupBy(band.alias("band")).agg(F.count("*").alias("sessions"), F.avg((F.col("hits") > 0).cast("double")).alias("presence"), (1000.0 * F.sum("hits") / F.sum("messages")).alias("per_1000"))


def spend(plans: DataFrame, since: Column, until: Column) -> DataFrame:
    """plans(name, usd, from_day, to_day inclusive): what subscriptions cost in a window of days, by the calendar (whole, if they
    begin in it) and spread over the days that they overlap it."""
    days = F.datediff("to_day", "from_day") + 1
    over = F.greatest(F.lit(0), F.datediff(F.least("to_day", until), F.greatest("from_day", since)) + 1)
    rows = plans.select("name", F.when(F.col("from_day").between(since, until), F.col("usd")).otherwise(0.0).alias("calendar_usd"), F.when(days > 0, F.col("usd") * over / days).otherwise(0.0).alias("amortised_usd"))
    return rows.groupBy("name").agg(F.sum("calendar_usd").alias("calendar_usd"), F.sum("amortised_usd").alias("amortised_usd"))
