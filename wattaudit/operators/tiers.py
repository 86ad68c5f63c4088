"""Rates of every step of the versions in force, by a range join of delivery voltages with voltage tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattaudit.functions.tiers import STEP_RATE
from wattaudit.operators.lookups import join_counted
from wattaudit.operators.versions import KEY, one_per_date

#: Width of a bin in kV, and the bin that holds all higher voltages.
BIN_KV = 10.0
TOP_BIN = 100


def _bin(kv: Column) -> Column:
    return F.least(F.greatest(F.floor(kv / BIN_KV), F.lit(0)), F.lit(TOP_BIN)).cast("int")


def tier_table(steps: DataFrame) -> DataFrame:
    """One row per step and tier (``tier_no`` in the order of the tariff's text), repeated for every bin that it touches."""
    tiers = steps.where(F.col("number").isNull()).select("version_no", "step_no", F.posexplode("tiers").alias("tier_no", "t"))
    tiers = tiers.select("version_no", "step_no", "tier_no", "t.*").where("low <= high")
    return tiers.withColumn("bin", F.explode(F.sequence(_bin(F.col("low")), _bin(F.col("high")))))


def step_rates(picked: DataFrame, versions: DataFrame, voltage: str = "delivery_voltage_kv") -> DataFrame:
    """Rows of ``picked`` (what ``pick_version`` gives for ``versions``) once per step of their version: step_no, step_name, rate.

    A flat step has its number, a tiered one the rate of the first tier that holds the voltage, bounds included; without
    voltage, or where no tier holds it, 0. Rows without version, and versions without steps, give no rows.

    Only the different (version, voltage) are joined with the tiers, by bins of voltage, and the first tier in order is taken by
    an aggregate; a row then meets the one row of its version and voltage.
    """

    def number(date: str) -> Column:
        return F.concat_ws("|", KEY, F.col(date).cast("string"))

    steps = one_per_date(versions).select(number("effective_date").alias("version_no"), F.posexplode("steps").alias("step_no", "s"))
    steps = steps.select("version_no", "step_no", "s.step_name", "s.number", "s.tiers")
    kv = F.coalesce(F.nanvl(F.col(voltage).cast("double"), F.lit(None)), F.lit(-1.0))
    rows = picked.where(F.col("version").isNotNull()).withColumns({"version_no": number("version.effective_date"), "_kv": kv})
    points = rows.groupBy("version_no", "_kv").agg(F.count(F.lit(1)).alias("_rows"))
    at = points.where("_kv >= 0").select("version_no", "_kv", _bin(F.col("_kv")).alias("bin"))
    held = at.join(tier_table(steps), ["version_no", "bin"]).where((F.col("low") <= F.col("_kv")) & (F.col("_kv") <= F.col("high")))
    first = held.groupBy("version_no", "_kv", "step_no").agg(F.min_by("rate", "tier_no").alias("tiered"))
    rate = F.coalesce("number", "tiered", F.lit(0).cast(STEP_RATE))
    priced = points.join(steps.drop("tiers"), "version_no").join(first, ["version_no", "_kv", "step_no"], "left")
    line = F.struct("step_no", "step_name", rate.alias("rate"))
    priced = priced.groupBy("version_no", "_kv", "_rows").agg(F.array_sort(F.collect_list(line)).alias("_lines"))
    joined = join_counted(rows, priced, ["version_no", "_kv"], "_rows", "inner")
    return joined.withColumn("_line", F.explode("_lines")).select(*picked.columns, "_line.*")
