"""Running usage counters per calendar month, as Structured Streaming queries in update mode.

State holds one row per month and model or operation, a few dozen a year, so it needs no watermark and no call is late. Calls that
come again under the same ``event_id`` (a file delivered twice, say) count once; for that the state also keeps the ids.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattaudit.operators.usage import PRICES, operation_counters, usage_cost, usage_counters


def _once(calls: DataFrame, keep: str | None) -> DataFrame:
    """Calls without repetitions; those without id are all different.

    Ids are dealt evenly, so no month or model is one task's burden. With ``keep`` (``62 days``, say) an id is forgotten that long after
    the latest call, and so is a call that comes later still; without it every id is kept and no call is left out.
    """
    named, nameless = calls.where("event_id is not null"), calls.where("event_id is null")
    if keep is None:
        return named.dropDuplicates(["event_id"]).unionByName(nameless)
    return named.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["event_id"]).unionByName(nameless)


def stream_usage(calls: DataFrame, prices: Mapping[str, tuple[float, float]] = PRICES, keep: str | None = None) -> DataFrame:
    """Requests, tokens and cost per month and model; each month counts from zero. ``keep``: see ``_once``."""
    priced = usage_cost(_once(calls.where(F.col("kind") == "llm"), keep), prices)
    month = F.date_format("ts", "yyyy-MM").alias("month")
    return priced.groupBy(month, F.col("key").alias("model")).agg(*usage_counters())


def stream_operations(calls: DataFrame, keep: str | None = None) -> DataFrame:
    """Requests, successes and failures per month and operation. ``keep``: see ``_once``."""
    month = F.date_format("ts", "yyyy-MM").alias("month")
    calls = _once(calls.where(F.col("kind") == "op"), keep)
    return calls.groupBy(month, F.col("key").alias("operation")).agg(*operation_counters())
