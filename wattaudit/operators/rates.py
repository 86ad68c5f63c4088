"""Monthly adjustment rates (TRA, RDM, SBC, RAM) and the override grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattaudit.functions.tiers import RATE
from wattaudit.functions.values import month_start, norm_sc
from wattaudit.operators.columns import as_date, as_number
from wattaudit.operators.lookups import BROADCAST_ROWS, lookup_join

# The four adjustment rates.
RATE_TYPES = ("tra", "rdm", "sbc", "ram")


def latest_month_rate(rates: DataFrame) -> DataFrame:
    """Newest rate of each (type, class, month): latest effective date, then highest id."""
    return (
        rates.groupBy("rate_type", "sc_code", month_start("effective_date").alias("month"))
        .agg(F.max_by(F.struct("id", "effective_date", "rate"), F.struct("effective_date", "id")).alias("r"))
        .select("rate_type", "sc_code", "month", "r.id", "r.effective_date", "r.rate")
    )


def monthly_rates(rates: DataFrame) -> DataFrame:
    """One row per (class, month) with the newest rate of each type as ``override_<type>``."""
    newest = [
        F.max_by(
            F.when(F.col("rate_type") == t, F.col("rate")),
            F.when(F.col("rate_type") == t, F.struct("effective_date", "id")),
        ).alias(f"override_{t}")
        for t in RATE_TYPES
    ]
    return rates.groupBy("sc_code", month_start("effective_date").alias("month")).agg(*newest)


def rates_for_bills(
    bills: DataFrame,
    rates: DataFrame,
    sc_code: Column | None = None,
    date: Column | None = None,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add the four rates of exactly the bill's class and month; null where none is stored (nothing is carried over)."""
    bills = bills.withColumns(
        {
            "_rate_sc": F.col("sc_code") if sc_code is None else sc_code,
            "_rate_month": month_start("bill_date" if date is None else date),
        }
    )
    monthly = monthly_rates(rates).withColumnsRenamed({"sc_code": "_rate_sc", "month": "_rate_month"})
    joined = lookup_join(bills, monthly, ["_rate_sc", "_rate_month"], how="left", max_rows=max_rows, spread=F.col("id"))
    return joined.drop("_rate_sc", "_rate_month")


def drop_undated(grid: DataFrame, date: str = "bill_date") -> DataFrame:
    """Grid rows whose date can be read."""
    return grid.withColumn(date, as_date(grid, date)).dropna(subset=[date])


def override_grid(bills: DataFrame, rates: DataFrame, sc_code: str | None = None) -> DataFrame:
    """Bills of one class with their four rates, unset rates shown as 0."""
    grid = bills.select(
        "id",
        F.col("read_date").alias("bill_date"),
        as_number(bills, "billed_kwh").alias("billed_kwh"),
        as_number(bills, "billed_demand").alias("billed_demand"),
        as_number(bills, "bill_amount", "decimal(18,2)").alias("bill_amount"),
        norm_sc("service_class").alias("service_class"),
    )
    if sc_code is not None:
        grid = grid.where(F.col("service_class") == norm_sc(F.lit(sc_code)))
    grid = rates_for_bills(drop_undated(grid), rates, F.col("service_class"))
    zero = F.lit(0).cast(RATE)
    return grid.withColumns({f"override_{t}": F.coalesce(f"override_{t}", zero) for t in RATE_TYPES})


def grid_rates(grid: DataFrame, sc_code: str = "service_class", date: str = "bill_date") -> DataFrame:
    """The override columns of a grid as rows (rate_type, sc_code, effective_date, rate), with the grid row's id."""
    present = [t for t in RATE_TYPES if f"override_{t}" in grid.columns]
    entries = F.array(
        *[F.struct(F.lit(t).alias("rate_type"), F.col(f"override_{t}").cast(RATE).alias("rate")) for t in present]
    )
    return grid.select(
        F.col("id").alias("seq"), F.col(sc_code).alias("sc_code"), F.col(date).alias("effective_date"),
        F.explode(entries).alias("e"),
    ).select("seq", "e.rate_type", "sc_code", "effective_date", "e.rate")


def entered_rates(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rates that were entered and may be stored (> 0), and entered ones that may not; blanks are in neither."""
    entered = entries.where(F.col("rate").isNotNull())
    return entered.where(F.col("rate") > 0), entered.where(F.col("rate") <= 0)


def override_counts(grid: DataFrame) -> DataFrame:
    """How many rates of each type a grid would store."""
    kept, _ = entered_rates(grid_rates(grid))
    return kept.groupBy(F.upper("rate_type").alias("rate_type")).agg(F.count(F.lit(1)).alias("n_saved"))
