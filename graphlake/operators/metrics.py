"""The metric log: summaries, latency, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.operators import statistics as S

#: Price of 1000 tokens by model, and of any other model.
PRICES = [("click", 0.001), ("view", 0.0005), ("purchase", 0.01)]
DEFAULT_PRICE = 0.002


def metric_rows(events: DataFrame, name: str, value: str, at: str, metadata: Column) -> DataFrame:
    """(timestamp, iso, type, name, value, metadata) rows of a log."""
    ts = F.col(at).cast("timestamp")
    return events.select(F.unix_micros(ts).alias("timestamp"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.lit("latency").alias("type"), F.col(name).alias("name"), F.col(value).alias("value"), metadata.alias("metadata"))


def summary(log: DataFrame) -> DataFrame:
    """Rows, first and last time and the seconds between, by type and over all (type `all`)."""
    agg = [F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")]
    both = log.rollup("type").agg(*agg)
    return both.select(F.coalesce("type", F.lit("all")).alias("type"), "n", F.round((F.col("last") - F.col("first")) / 1_000_000, 3).alias("seconds"))


def filter_metrics(log: DataFrame, kind: str | None = None, name: str | None = None) -> DataFrame:
    out = log if kind is None else log.where(F.col("type") == kind)
    return out if name is None else out.where(F.col("name") == name)


def latency_stats(log: DataFrame, by: str) -> DataFrame:
    """(by, n, total, mean, least, most, p50, p95, p99): percentiles are exact and come by selection, so no group's values are held."""
    held = log.groupBy(by).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    q = S.quantiles(log, [by], "value", [0.5, 0.95, 0.99]).withColumnRenamed(by, "by_")
    both = held.join(q, held[by].eqNullSafe(q["by_"]), "left")
    return both.select(by, "n", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"), "least", "most", *[F.round(F.get("q", F.lit(i)), 4).alias(f"p{p}") for i, p in enumerate((50, 95, 99))])


def cost_rows(calls: DataFrame, model: str, tokens: Column) -> DataFrame:
    """Adds cost: tokens / 1000 times the model's price, or the default's."""
    prices = F.broadcast(calls.sparkSession.createDataFrame(PRICES, f"{model} string, price double"))  # a fixed list
    return calls.join(prices, model, "left").withColumn("cost", F.round(tokens / 1000 * F.coalesce("price", F.lit(DEFAULT_PRICE)), 9)).drop("price")


def cost_rollup(costs: DataFrame, model: str, use_case: str) -> DataFrame:
    """Cost and calls by model, by use case and in all: one pass over three grouping sets."""
    sets = costs.groupingSets([[model], [use_case], []], model, use_case)
    return sets.agg(F.round(F.sum("cost"), 6).alias("cost"), F.count("*").alias("calls")).select(F.coalesce(model, F.lit("*")).alias("model"), F.coalesce(use_case, F.lit("*")).alias("use_case"), "cost", "calls")


def category_stats(rows: DataFrame, category: str) -> DataFrame:
    return rows.groupBy(category).agg(F.count("*").alias("n"), F.round(F.count_if("success") / F.count("*"), 6).alias("rate"), F.round(F.avg("value"), 4).alias("mean"))


def slowest(rows: DataFrame, value: str, key: str, n: int = 5) -> DataFrame:
    return rows.orderBy(F.desc(value), key).limit(n)


def stage_share(rows: DataFrame, run: str, value: str) -> DataFrame:
    """Adds share: a stage's part of its run's total."""
    totals = rows.groupBy(F.col(run).alias("run_")).agg(F.sum(value).alias("whole_"))  # summed up before the shuffle, so a run of any size is no task's alone
    joined = rows.join(totals, F.col(run).eqNullSafe(F.col("run_")))
    return joined.withColumn("share", F.round(F.coalesce(F.try_divide(F.col(value), F.col("whole_")), F.lit(0.0)), 6)).drop("run_", "whole_")
