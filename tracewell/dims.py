"""Configuration dimensions: list prices, cost kinds and the rules that look them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: USD per million tokens (input, output).
RATES = {
    "claude-fable-5": (10.0, 50.0),
    "claude-opus-4-8": (5.0, 25.0),
    "claude-opus-4-7": (5.0, 25.0),
    "claude-opus-4-6": (5.0, 25.0),
    "claude-sonnet-4-6": (3.0, 15.0),
    "claude-haiku-4-5": (1.0, 5.0),
    "gpt-5.5": (5.0, 30.0),
    "gpt-5.4": (2.5, 15.0),
    "gpt-5.4-mini": (0.75, 4.5),
    "gemini-3.5-flash": (1.5, 9.0),
    "claude-3.5-haiku": (0.8, 4.0),
}
#: What cache tokens cost, as a multiple of the input price.
WRITE_5M, WRITE_1H, READ = 1.25, 2.0, 0.1
#: Provider prefixes that a model id may carry.
PROVIDER_PREFIXES = ("anthropic/", "google/", "openai/", "openrouter/", "deepseek/", "x-ai/")
#: How a provider's use is paid for, and the models that override it.
PROVIDER_KINDS = {"anthropic_api": "billed", "openrouter": "billed", "openai_codex": "subscription", "claude_code": "subscription", "ollama": "free", "vllm": "free"}
MODEL_KINDS = {"faux": "free", "unknown": "free"}


def rates(spark: SparkSession) -> DataFrame:
    """rate_key, input_rate, output_rate"""
    return spark.createDataFrame([(k, *v) for k, v in RATES.items()], "rate_key string, input_rate double, output_rate double")


def bare_model(model: Column) -> Column:
    """A model id in lower case, without its provider's prefix."""
    prefix = "|".join(p.replace(".", r"\.") for p in PROVIDER_PREFIXES)
    return F.regexp_replace(F.lower(model), f"^(?:{prefix})", "")


def rate_keys(models: DataFrame, rate_table: DataFrame, column: str = "model") -> DataFrame:
    """Each distinct model with the longest rate key that it starts with; models without one are left out.

    The prefix join runs over distinct models against the rate table, whose few rows are configuration."""
    distinct = models.select(F.col(column).alias("model")).where("model is not null").distinct()
    bare = bare_model(F.col("model"))
    found = distinct.join(F.broadcast(rate_table), bare.startswith(F.col("rate_key")))
    best = F.max_by(F.struct("rate_key", "input_rate", "output_rate"), F.length("rate_key"))
    return found.groupBy("model").agg(best.alias("r")).select("model", "r.*")


def with_rates(df: DataFrame, model: str = "model") -> DataFrame:
    """df with rate_key, input_rate, output_rate of the longest rate key that each row's model starts with (null without one): one
    expression over the few rates, no join and no second pass over df."""
    bare = bare_model(F.col(model))
    longest_first = sorted(RATES, key=lambda k: (-len(k), k))
    found = F.coalesce(*[F.when(bare.startswith(k), F.struct(F.lit(k).alias("rate_key"), F.lit(RATES[k][0]).alias("input_rate"), F.lit(RATES[k][1]).alias("output_rate"))) for k in longest_first])
    return df.withColumn("_rate", found).select(*df.columns, "_rate.rate_key", "_rate.input_rate", "_rate.output_rate")


def priced(df: DataFrame, model: str = "model") -> DataFrame:
    """df(model, prompt_tokens, completion_tokens, cache_read_tokens, cache_write_tokens) with rate_key and cost (USD at list
    prices; 0 where the model has no rate)."""
    return with_rates(df, model).withColumn("cost", F.coalesce(list_price(), F.lit(0.0))).drop("input_rate", "output_rate")


def to_grid(usd: Column) -> Column:
    """USD in whole units of 1e-10: engines round decimal places of binary numbers differently, but not these."""
    return F.round(usd * 1e10).cast("long") / 1e10


def list_price() -> Column:
    """The price formula over token and rate columns."""
    i, o = F.col("input_rate"), F.col("output_rate")
    return (F.col("prompt_tokens") * i + F.col("cache_write_tokens") * i * WRITE_5M + F.col("cache_read_tokens") * i * READ + F.col("completion_tokens") * o) / 1e6


def _lookup(column: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), column)


def cost_kind(provider: Column, model: Column) -> Column:
    """free for no model, else the model's override, else the provider's kind, else unknown."""
    m = F.lower(F.coalesce(model, F.lit("")))
    return F.when(m == "", "free").otherwise(F.coalesce(_lookup(m, MODEL_KINDS), _lookup(F.lower(F.coalesce(provider, F.lit(""))), PROVIDER_KINDS), F.lit("unknown")))


def is_noise(model: Column) -> Column:
    """The test model's rows."""
    return F.lower(F.coalesce(model, F.lit(""))) == "faux"


def model_family(model: Column) -> Column:
    m = F.lower(F.coalesce(model, F.lit("")))
    families = ("fable", "opus", "sonnet", "haiku", "gpt", "gemini", "qwen")
    found = F.lit("other")
    for f in reversed(families):
        found = F.when(m.contains(f), f).otherwise(found)
    return found
