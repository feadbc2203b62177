"""The stream of tool calls: predicates over commands and edits, and what they go with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import CODE_HEREDOC, DANGER, EDITS, FORCE, HEREDOC, READS, SHELL_WRITE, SHELLS, has, tool_of
from tracewell.operators.sessions import KEY

LARGE = 800
SHELL_PREDICATES = ("heredoc", "code_in_heredoc", "shell_file_write", "large_bash", "dangerous_bash", "force_push")
EDIT_PREDICATES = ("edit_loop", "edit_before_read")


def violations(ev: DataFrame) -> DataFrame:
    """Eight flags of each session with tool calls."""
    calls = ev.where("kind = 'tool_call'").select(*KEY, "id", tool_of(F.col("tool_name")).alias("tool"), "command", "file_path")
    file = Window.partitionBy(*KEY, "file_path").orderBy("id")
    so_far = file.rowsBetween(Window.unboundedPreceding, -1)
    shell, edit = F.col("tool").isin(*SHELLS), F.col("tool").isin(*EDITS) & F.col("file_path").isNotNull()
    calls = calls.withColumns({
        "read_before": F.coalesce(F.max(F.col("tool").isin(*READS)).over(so_far), F.lit(False)),
        "edits": F.count_if(edit).over(file.rowsBetween(Window.unboundedPreceding, 0)),
    })
    command = F.when(shell, F.coalesce("command", F.lit("")))
    flags = {
        "heredoc": has(command, HEREDOC, False), "code_in_heredoc": has(command, CODE_HEREDOC, False), "shell_file_write": has(command, SHELL_WRITE), "large_bash": F.coalesce(F.length(command) > LARGE, F.lit(False)),
        "dangerous_bash": has(command, DANGER), "force_push": has(command, FORCE), "edit_loop": edit & (F.col("edits") >= 5), "edit_before_read": edit & ~F.col("read_before"),
    }
    return calls.groupBy(*KEY).agg(F.count("*").alias("calls"), F.max(shell).alias("has_shell"), F.max(F.col("tool").isin(*EDITS)).alias("has_edit"), *[F.max(v).alias(k) for k, v in flags.items()])


def unpivoted(flags: DataFrame) -> DataFrame:
    """A row for each session and predicate: predicate, fired, exposed (whether it could)."""
    names = (*SHELL_PREDICATES, *EDIT_PREDICATES)
    stack = ", ".join(f"'{n}', {n}, {'has_shell' if n in SHELL_PREDICATES else 'has_edit'}" for n in names)
    return flags.select(*KEY, "calls", F.expr(f"stack({len(names)}, {stack}) as (predicate, fired, exposed)"))


def prevalence(flags: DataFrame) -> DataFrame:
    """Percent of a fleet's tool-using sessions in which a predicate fired."""
    return unpivoted(flags).groupBy("fleet", "predicate").agg(F.count("*").alias("sessions"), F.count_if("fired").alias("fired"), (100 * F.avg(F.col("fired").cast("double"))).alias("percent"))


def at_risk_rates(flags: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Rates over those sessions that could fire a predicate: of all, of each fleet and, with hosts(fleet, session, host), of
    each fleet's hosts."""
    rows, sets, keys = unpivoted(flags).where("exposed"), [("predicate",), ("predicate", "fleet")], ["predicate", "fleet"]
    if hosts is not None:
        rows, sets, keys = rows.join(hosts, list(KEY), "left"), [*sets, ("predicate", "fleet", "host")], [*keys, "host"]
    return rows.groupingSets(sets, *keys).agg(F.count("*").alias("sessions"), F.count_if("fired").alias("fired"), F.avg(F.col("fired").cast("double")).alias("rate"))


def rate_lift(flags: DataFrame, language: DataFrame) -> DataFrame:
    """Markers per message of sessions with a predicate over those without. language: fleet, session, messages, hits."""
    rows = unpivoted(flags).join(language, list(KEY))
    with_, without = F.col("fired"), ~F.col("fired")

    def rate(which):
        return F.try_divide(F.sum(F.when(which, F.col("hits"))).cast("double"), F.sum(F.when(which, F.col("messages"))))

    return rows.groupBy("predicate").agg(F.count_if(with_).alias("n_with"), F.count_if(without).alias("n_without"), rate(with_).alias("rate_with"), rate(without).alias("rate_without"), F.try_divide(rate(with_), rate(without)).alias("lift"))


def banded_lift(flags: DataFrame, language: DataFrame) -> DataFrame:
    """rate_lift within bands of sessions by their number of tool calls."""
    band = F.when(F.col("calls") < 2, "S").when(F.col("calls") < 5, "M").otherwise("L")
    rows = unpivoted(flags).join(language, list(KEY)).withColumn("band", band)

    def rate(which):
        return F.try_divide(F.sum(F.when(which, F.col("hits"))).cast("double"), F.sum(F.when(which, F.col("messages"))))

    return rows.groupBy("band", "predicate").agg(F.count_if("fired").alias("n_with"), F.count_if(~F.col("fired")).alias("n_without"), F.try_divide(rate(F.col("fired")), rate(~F.col("fired"))).alias("lift"))
