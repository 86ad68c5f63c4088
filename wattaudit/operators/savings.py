"""Two rate classes compared bill by bill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattaudit.functions.text import clean_columns
from wattaudit.operators.columns import as_date, as_number, conform_names, require_columns

# Names in expected-bill exports and the bill columns they stand for.
EXPORT_RENAMES = {"kwh": "billed_kwh", "demand_kw": "billed_demand", "expected_bill": "bill_amount"}
REQUIRED = ("bill_date", "billed_kwh", "billed_demand", "bill_amount")


def monthly(bills: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Export rows under bill column names, with ``month`` = the bill date as MM-dd-yy."""
    bills = conform_names(clean_columns(bills), EXPORT_RENAMES)
    require_columns(bills, REQUIRED)
    return bills.select(
        *keep,
        as_date(bills, "bill_date").alias("bill_date"),
        F.date_format(as_date(bills, "bill_date"), "MM-dd-yy").alias("month"),
        as_number(bills, "billed_demand").alias("billed_demand"),
        as_number(bills, "billed_kwh").alias("billed_kwh"),
        as_number(bills, "bill_amount", "decimal(18,2)").alias("bill_amount"),
    )


def savings(old: DataFrame, new: DataFrame, on: tuple[str, ...] = ("bill_account",)) -> DataFrame:
    """Old against new bill of the same account and date: both amounts and old − new, with the month label.

    ``on`` names the account columns, at least one. Bills of one account that share a date each meet each other; without
    an account all bills of a day would, so that is refused.
    """
    if not on:
        raise ValueError("savings needs an account column to join on")
    keys = [*on, "bill_date", "month"]
    a = monthly(old, on).withColumnsRenamed({c: f"{c}_old" for c in ("billed_demand", "billed_kwh", "bill_amount")})
    b = monthly(new, on).withColumnsRenamed({c: f"{c}_new" for c in ("billed_demand", "billed_kwh", "bill_amount")})
    return a.join(b, keys).select(
        *keys,
        F.col("billed_demand_old").alias("old_demand"),
        F.col("billed_demand_new").alias("new_demand"),
        F.col("billed_kwh_old").alias("kwh"),
        F.col("bill_amount_old").alias("old_rate_bill"),
        F.col("bill_amount_new").alias("new_rate_bill"),
        (F.col("bill_amount_old") - F.col("bill_amount_new")).cast("decimal(18,2)").alias("monthly_savings"),
    )


def savings_totals(compared: DataFrame) -> DataFrame:
    names = (("old_rate_bill", "old_total"), ("new_rate_bill", "new_total"), ("monthly_savings", "total_savings"))
    return compared.agg(*[F.sum(c).cast("decimal(28,2)").alias(n) for c, n in names])
