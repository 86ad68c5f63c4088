"""Counters over model calls and service operations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Price in dollars per million input and output tokens.
PRICES = {"gpt-4.1-mini": (0.40, 1.60), "gpt-4.1": (2.00, 8.00)}

COST = "decimal(28,8)"


def call_cost(
    model: Column, input_tokens: Column, output_tokens: Column, prices: Mapping[str, tuple[float, float]] = PRICES
) -> Column:
    """Dollars of a call with eight decimals; 0 for a model without price."""

    def price(place: int) -> Column:
        found = F.lit(0).cast("decimal(10,4)")
        for name, pair in prices.items():
            found = F.when(model == name, F.lit(str(pair[place])).cast("decimal(10,4)")).otherwise(found)
        return found

    tokens_in, tokens_out = input_tokens.cast("decimal(18,0)"), output_tokens.cast("decimal(18,0)")
    millionth = F.lit("0.000001").cast("decimal(6,6)")
    cost_in = (tokens_in * price(0)).cast("decimal(28,4)") * millionth
    cost_out = (tokens_out * price(1)).cast("decimal(28,4)") * millionth
    return (cost_in + cost_out).cast(COST)


def usage_cost(calls: DataFrame, prices: Mapping[str, tuple[float, float]] = PRICES) -> DataFrame:
    """Calls with ``cost``; the price table is a handful of literals, so there is no join."""
    return calls.withColumn("cost", call_cost(F.col("key"), F.col("input_tokens"), F.col("output_tokens"), prices))


def usage_counters() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("requests"),
        F.sum("input_tokens").cast("long").alias("input_tokens"),
        F.sum("output_tokens").cast("long").alias("output_tokens"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).cast("long").alias("total_tokens"),
        F.sum("cost").cast(COST).alias("cost"),
    ]


def operation_counters() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("success")).alias("success"),
        F.count_if(~F.col("success")).alias("failures"),
    ]


def _by_month(calls: DataFrame, kind: str) -> DataFrame:
    return calls.where(F.col("kind") == kind).withColumn("month", F.date_format("ts", "yyyy-MM"))


def _with_totals(calls: DataFrame, key: str, counters: list[Column]) -> DataFrame:
    """Counters per month and key and per month; a null month or key is a value like any other."""
    return calls.groupingSets([["month", key], ["month"]], "month", key).agg(
        *counters, (F.grouping(key) == 1).alias("is_total")
    )


def llm_usage(
    calls: DataFrame, prices: Mapping[str, tuple[float, float]] = PRICES, month: str | None = None
) -> DataFrame:
    """Requests, tokens and cost per month and model; ``is_total`` marks the month's total. Calls without time have month null."""
    calls = _by_month(calls, "llm")
    if month is not None:
        calls = calls.where(F.col("month") == month)
    priced = usage_cost(calls, prices).withColumnRenamed("key", "model")
    return _with_totals(priced, "model", usage_counters())


def op_usage(calls: DataFrame, month: str | None = None) -> DataFrame:
    """Requests, successes and failures per month and operation; ``is_total`` marks the month's total."""
    calls = _by_month(calls, "op")
    if month is not None:
        calls = calls.where(F.col("month") == month)
    return _with_totals(calls.withColumnRenamed("key", "operation"), "operation", operation_counters())


def recent_calls(calls: DataFrame, n: int = 20) -> DataFrame:
    """The last calls of each kind, newest first; every task keeps only its own last ``n`` before the shuffle."""
    order = W.partitionBy("kind").orderBy(F.desc("ts"), F.desc("event_id"))
    return calls.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
