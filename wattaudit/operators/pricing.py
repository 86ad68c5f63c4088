"""Expected bill: every step of the tariff version in force, adjustment rates, minimum bill and variance.

A bill is joined with its version, whose steps are an array, and priced inside its own row: no shuffle. Money is decimal
throughout and is rounded once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattaudit.functions.conditions import by_block, condition_holds, formula_value, template_blocks, with_templates
from wattaudit.functions.tiers import RATE, STEP_RATE, tier_rate
from wattaudit.operators.lookups import BROADCAST_ROWS, lookup_join
from wattaudit.operators.rates import rates_for_bills
from wattaudit.operators.versions import pick_version
from wattaudit.sources.bills import with_voltage

# Charge types and the usage each rate multiplies.
FIXED = ("fixed_fee",)
PER_KWH = ("per_kwh", "energy_charge")
PER_KW = ("per_kw", "demand_charge")
PER_RKVA = ("per_rkva", "reactive_demand_fee")
MINIMUM = ("minimum_charge", "minimum_bill")

# Classes whose decoupling rate applies to energy, and those where it applies to demand.
RDM_ENERGY = ("SC1", "SC1C", "SC2")
RDM_DEMAND = ("SC2D", "SC3", "SC3A")

USAGE = "decimal(20,6)"
COST = "decimal(38,10)"


def _usage(name: str) -> Column:
    value = F.coalesce(F.col(name), F.lit(0.0))
    return F.when(F.isnan(value.cast("double")), F.lit(0)).otherwise(value).cast(USAGE)


def _variables() -> dict[str, Column]:
    return {
        "user.billed_kwh": F.col("_kwh"),
        "user.billed_demand": F.col("_kw"),
        "user.billed_rkva": F.col("_rkva"),
        "user.days_used": F.col("_days"),
        "user.bill_date": F.col("_bill_date"),
        "delivery_voltage": F.col("_voltage"),
    }


def _prepared(bills: DataFrame, bill_date: Column) -> DataFrame:
    """Usage with null as 0, days 0/null as 30, and optional columns that a bill table may lack."""
    bills = with_voltage(bills)
    optional = {"billed_rkva": "double", "delivery_voltage_kv": "double", "days_used": "int", "billed_demand": "double"}
    bills = bills.withColumns({c: F.lit(None).cast(t) for c, t in optional.items() if c not in bills.columns})
    days = F.coalesce(F.col("days_used"), F.lit(0))
    return bills.withColumns(
        {
            "_kwh": _usage("billed_kwh"),
            "_kw": _usage("billed_demand"),
            "_rkva": _usage("billed_rkva"),
            "_days": F.when(days == 0, 30).otherwise(days),
            "_bill_date": bill_date,
            "_voltage": F.col("delivery_voltage_kv").cast("double"),
        }
    )


def _text(amount: Column, places: int = 2) -> Column:
    return amount.cast(f"decimal(38,{places})").cast("string")


def _step_cost(step: Column) -> Column:
    """Cost of a step, null for charge types that are not priced."""
    rate = tier_rate(step["number"], step["tiers"], F.col("_voltage"))
    kind = step["charge_type"]
    cost = F.when(kind.isin(*FIXED), rate.cast(COST))
    for types, usage in ((PER_KWH, "_kwh"), (PER_KW, "_kw"), (PER_RKVA, "_rkva")):
        cost = cost.when(kind.isin(*types), (rate * F.col(usage)).cast(COST))
    return cost


def _total(costs: Column) -> Column:
    return F.aggregate(costs, F.lit(0).cast(COST), lambda acc, c: (acc + F.coalesce(c, F.lit(0).cast(COST))).cast(COST))


def expected_bill(
    bills: DataFrame,
    versions: DataFrame,
    rates: DataFrame | None = None,
    class_aliases: dict[str, str] | None = None,
    bill_date: Column | None = None,
    trace: bool = False,
    detail: bool = False,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Price every bill: id, bill_account, bill_date, sc_code, actual_bill, expected_bill, variance, status.

    ``rates`` holds monthly adjustment rates (applied for the class codes of the bills after ``class_aliases``, such as
    ``{"SC2ND": "SC2"}``). Status is SKIPPED without a tariff (expected and variance 0) and FAILED when a minimum is
    prose (expected null). ``unpriced_steps`` lists the charge types that held but carry no price. ``detail`` adds kwh,
    demand_kw, tra and rdm; ``trace`` adds the ordered text lines of the calculation.
    """
    when_billed = F.coalesce("read_date", "bill_date") if bill_date is None else bill_date
    versions, blocks = template_blocks(with_templates(versions, "condition"), ["norm_code", "effective_date"], "condition")
    priced = pick_version(_prepared(bills, when_billed), versions, True, bill_date=F.col("_bill_date"), max_rows=max_rows)
    code = F.col("norm_code")
    for alias, target in (class_aliases or {}).items():
        code = F.when(F.col("norm_code") == alias, target).otherwise(code)
    priced = priced.withColumn("_rate_code", code)
    if rates is None:
        priced = priced.withColumns({f"override_{t}": F.lit(None).cast(RATE) for t in ("tra", "rdm")})
    else:
        priced = rates_for_bills(priced, rates, F.col("_rate_code"), F.col("_bill_date"), max_rows=max_rows)

    def finish(rows: DataFrame, known: dict[str, list[str]]) -> DataFrame:
        return _priced(rows, known["condition"], trace, detail)

    return by_block(priced, F.col("version.template_block"), blocks, finish)


def _priced(priced: DataFrame, known: list[str], trace: bool, detail: bool) -> DataFrame:
    """Bills with their version and rates, priced; ``known`` are the templates of the conditions of these versions."""

    def held(step: Column) -> Column:
        return condition_holds(step["condition"], step["condition_template"], step["condition_numbers"], known, _variables())

    no_steps = F.array().cast(priced.schema["version"].dataType["steps"].dataType)
    steps = F.coalesce(F.col("version.steps"), no_steps)
    priced = priced.withColumn("_held", F.filter(steps, held))
    kinds = F.col("_held")
    minimums = F.filter(kinds, lambda s: s["charge_type"].isin(*MINIMUM))
    minimum = F.array_max(F.transform(minimums, lambda s: F.coalesce(s["number"], F.lit(0).cast(STEP_RATE))))
    priced_types = FIXED + PER_KWH + PER_KW + PER_RKVA
    charged = F.filter(kinds, lambda s: s["charge_type"].isin(*priced_types))
    ignored = F.filter(kinds, lambda s: ~s["charge_type"].isin(*priced_types, *MINIMUM))
    tra = F.coalesce("override_tra", F.lit(0).cast(RATE))
    rdm = F.coalesce("override_rdm", F.lit(0).cast(RATE))
    rdm_usage = F.when(F.col("_rate_code").isin(*RDM_ENERGY), F.col("_kwh")).when(
        F.col("_rate_code").isin(*RDM_DEMAND), F.col("_kw")
    )
    priced = priced.withColumns(
        {
            "_costs": F.transform(charged, _step_cost),
            "_minimum": minimum.cast(COST),
            "_failed": F.exists(minimums, lambda s: s["bad_value"]),
            "_tra": (tra * F.col("_kwh")).cast(COST),
            "_rdm": F.coalesce((rdm * rdm_usage).cast(COST), F.lit(0).cast(COST)),
            "unpriced_steps": F.transform(ignored, lambda s: s["charge_type"]),
        }
    )
    before = (_total(F.col("_costs")) + F.col("_tra") + F.col("_rdm")).cast(COST)
    actual = F.coalesce(F.col("bill_amount"), F.lit(0)).cast("decimal(18,2)")
    found = F.col("version").isNotNull()
    status = F.when(~found, "SKIPPED").when(F.col("_failed"), "FAILED").otherwise("SUCCESS")
    priced = priced.withColumns({"_before": before, "status": status, "actual_bill": actual})
    total = F.greatest("_before", F.col("_minimum"))
    expected = F.when(F.col("status") == "SUCCESS", total).when(~found, F.lit(0).cast(COST))
    variance = F.when(F.col("status") == "SUCCESS", F.col("actual_bill") - total).when(~found, F.lit(0).cast(COST))
    columns = [
        "id",
        "bill_account",
        F.col("_bill_date").alias("bill_date"),
        F.col("norm_code").alias("sc_code"),
        "actual_bill",
        expected.cast("decimal(18,2)").alias("expected_bill"),
        variance.cast("decimal(18,2)").alias("variance"),
        "status",
        "unpriced_steps",
    ]
    if detail:
        columns += [
            F.col("_kwh").cast("double").alias("kwh"), F.col("_kw").cast("double").alias("demand_kw"),
            tra.alias("tra"), rdm.alias("rdm"),
        ]
    if trace:
        names = F.transform(charged, lambda s: s["step_name"])
        lines = F.zip_with(names, F.col("_costs"), lambda n, c: F.concat(n, F.lit(": $"), _text(c)))
        tra_line = F.when(
            tra != 0,
            F.concat(
                F.lit("TRA Override: "), _text(tra, 5), F.lit(" × "), _text(F.col("_kwh")), F.lit(" kWh = $"),
                _text(F.col("_tra")),
            ),
        )
        energy = F.col("_rate_code").isin(*RDM_ENERGY)
        rdm_line = F.when(
            (rdm != 0) & rdm_usage.isNotNull(),
            F.concat(
                F.lit("RDM Override ("), F.when(energy, "Energy").otherwise("Demand"), F.lit("): "), _text(rdm, 5),
                F.lit(" × "), _text(rdm_usage), F.when(energy, " kWh = $").otherwise(" kW = $"), _text(F.col("_rdm")),
            ),
        )
        minimum_line = F.when(
            F.col("_before") < F.col("_minimum"),
            F.concat(F.lit("Minimum bill enforced: $"), _text(F.col("_minimum"))),
        )
        full = F.concat(lines, F.array_compact(F.array(tra_line, rdm_line, minimum_line)))
        columns.append(F.when(found, full).otherwise(F.array(F.lit("No tariff logic"))).alias("trace"))
    return priced.select(*columns)


def expected_bill_legacy(
    bills: DataFrame,
    versions: DataFrame,
    default_sc: str = "SC1",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Older pricing: exact class match, the last version of a class, only ``fixed_fee`` and ``formula`` steps.

    Its variance is expected − actual. A step whose formula has no value is skipped.
    """
    versions = with_templates(versions, "condition", "formula")
    last = versions.groupBy("sc_code").agg(F.max_by("steps", F.struct("doc_id", "pos")).alias("steps"))
    last, blocks = template_blocks(last, ["sc_code"], "condition", "formula")
    bills = _prepared(bills, F.col("bill_date")).withColumn(
        "sc_code", F.coalesce(F.col("service_class"), F.lit(default_sc))
    )
    priced = lookup_join(bills, last, ["sc_code"], how="left", max_rows=max_rows, spread=F.col("id"))

    def finish(rows: DataFrame, known: dict[str, list[str]]) -> DataFrame:
        return _priced_legacy(rows, known["condition"], known["formula"])

    return by_block(priced, F.col("template_block"), blocks, finish)


def _priced_legacy(priced: DataFrame, conditions: list[str], formulas: list[str]) -> DataFrame:
    variables = _variables()
    variables.pop("delivery_voltage")
    held = F.filter(
        F.col("steps"),
        lambda s: s["charge_type"].isin("fixed_fee", "formula")
        & condition_holds(s["condition"], s["condition_template"], s["condition_numbers"], conditions, variables),
    )

    def cost(step: Column) -> Column:
        formula = formula_value(
            step["formula"], step["formula_template"], step["formula_numbers"], formulas, variables
        ).try_cast(COST)
        flat = F.when(~step["bad_value"], F.coalesce(step["number"], F.lit(0).cast(STEP_RATE)).cast(COST))
        return F.when(step["charge_type"] == "formula", formula).otherwise(flat)

    found = F.col("steps").isNotNull()
    priced = priced.withColumn("_costs", F.transform(held, cost))
    actual = F.coalesce(F.col("bill_amount"), F.lit(0)).cast("decimal(18,2)")
    total = _total(F.col("_costs"))
    zero = F.lit(0).cast("decimal(18,2)")
    return priced.select(
        "id",
        "bill_account",
        "sc_code",
        actual.alias("actual_bill"),
        F.when(found, total.cast("decimal(18,2)")).otherwise(zero).alias("expected_bill"),
        F.when(found, (total - actual).cast("decimal(18,2)")).otherwise(zero).alias("variance"),
        F.when(found, "SUCCESS").otherwise("SKIPPED").alias("status"),
    )

