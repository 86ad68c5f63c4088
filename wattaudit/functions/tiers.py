"""Rates that depend on the delivery voltage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Monthly rates, and the values of tariff steps, which may be far smaller.
RATE = "decimal(18,6)"
STEP_RATE = "decimal(24,12)"
INFINITY = float("inf")


def tier_bounds(label: Column) -> Column:
    """``0-2.2 kV`` → [0, 2.2]; ``Over 60 kV`` → [60, ∞); ``13.2 kV`` → [13.2, 13.2]; no number → [0, ∞)."""
    text = F.trim(F.replace(label, F.lit("kV"), F.lit("")))
    numbers = F.transform(
        F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda n: n.cast("double")
    )
    count = F.size(numbers)
    first = F.coalesce(F.get(numbers, F.lit(0)), F.lit(0.0))
    over = F.lower(text).startswith("over")
    high = F.when(over | (count == 0), F.lit(INFINITY)).when(count >= 2, F.get(numbers, F.lit(1))).otherwise(first)
    return F.struct(first.alias("low"), high.alias("high"))


def tiers_of(rates_by_label: Column) -> Column:
    """Map label → rate as an array of (low, high, rate), in the order of the map."""

    def entry(e: Column) -> Column:
        bounds = tier_bounds(e["key"])
        return F.struct(
            bounds["low"].alias("low"), bounds["high"].alias("high"), e["value"].try_cast(STEP_RATE).alias("rate")
        )

    return F.transform(F.map_entries(rates_by_label), entry)


def tier_rate(number: Column, tiers: Column, voltage: Column) -> Column:
    """Flat rate, or the rate of the first tier that holds the voltage (bounds included); otherwise 0."""
    hit = F.get(F.filter(tiers, lambda t: (t["low"] <= voltage) & (voltage <= t["high"])), F.lit(0))
    return F.coalesce(number, hit["rate"], F.lit(0).cast(STEP_RATE))
