"""Quality rules R1-R6 over the billing history of each account, as one detector.

All rules share one shuffle by (account, chunk) and one sort by (read_date, id); see ``history`` for how a hot account is
cut into chunks without changing any result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattaudit.functions.privacy import tokenize
from wattaudit.functions.values import is_municipality
from wattaudit.operators.history import HotKeys, cut, profile

# Rule ids.
R1_USAGE_SPIKE = "R1_USAGE_SPIKE"
R1_USAGE_DROP = "R1_USAGE_DROP"
R1_CHARGE_SPIKE = "R1_CHARGE_SPIKE"
R1_CHARGE_DROP = "R1_CHARGE_DROP"
R2_DAYS = "R2_BILL_DAYS_OUT_OF_RANGE"
R3_VALUES = "R3_ZERO_OR_NEGATIVE_USAGE_OR_CHARGE"
R4_TAX = "R4_SALES_TAX_SUSPECT"
R5_SWING = "R5_LOAD_FACTOR_SWING"
R6_DUPLICATE = "R6_DUPLICATE_PERIOD"

# Rule id → (severity, is_overcharge_risk).
GRADES = {
    R1_USAGE_SPIKE: ("medium", True),
    R1_USAGE_DROP: ("medium", False),
    R1_CHARGE_SPIKE: ("medium", True),
    R1_CHARGE_DROP: ("medium", False),
    R2_DAYS: ("low", False),
    R3_VALUES: ("medium", False),
    R4_TAX: ("low", False),
    R5_SWING: ("medium", False),
    R6_DUPLICATE: ("high", True),
}

def _conditions() -> dict[str, Column]:
    """What is counted per account: bills with demand, with sales tax, and with zero or no sales tax."""
    tax = F.coalesce(F.col("sales_tax_amount"), F.lit(0))
    return {"n_demand": F.col("kw_demand") > 0, "n_taxed": tax > 0, "n_untaxed": tax == 0}


def _facts(bills: DataFrame) -> DataFrame:
    return bills.select(
        "bill_account",
        F.col("id").alias("bill_id"),
        F.lit(None).cast("date").alias("period_start"),
        F.col("read_date").alias("period_end"),
        F.col("days_used").alias("bill_days"),
        F.col("billed_kwh").alias("kwh_usage"),
        F.col("billed_demand").alias("kw_demand"),
        F.col("bill_amount").alias("total_amount"),
        F.col("sales_tax_amt").alias("sales_tax_amount"),
        "load_factor",
        is_municipality("customer").alias("is_municipality"),
        F.lit(False).alias("is_holiday_month"),
    )


def _history(facts: DataFrame, lookback: int, lookahead: int, hot: HotKeys) -> DataFrame:
    """Facts cut into chunks."""
    profiled = profile(facts, "bill_account", "bill_id", **{n: F.count_if(c) for n, c in _conditions().items()})
    return cut(facts, "bill_account", "period_end", "bill_id", profiled, lookback, lookahead, hot)


def _ordered() -> W:
    return W.partitionBy("bill_account", "chunk").orderBy("period_end", "bill_id")


def _account_counts() -> dict[str, Column]:
    """Account-wide counts of ``_conditions`` and of bills.

    Those of hot accounts come with the cut. Any other account lies in one chunk, so a window sees all of it; its order
    is that of the other rules, which lets all of them share one sort and one pass.
    """
    whole = _ordered().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    counts = {n: F.coalesce(F.col(f"hot_{n}"), F.count_if(c).over(whole)) for n, c in _conditions().items()}
    return {**counts, "n_bills": F.coalesce("hot_n_rows", F.count(F.lit(1)).over(whole))}


def qc_facts(bills: DataFrame, key: str, hot: HotKeys = HotKeys()) -> DataFrame:
    """Bills as the rules see them: flags, whether the account ever has demand, and its token instead of its number."""
    facts = _facts(bills)
    parts = _history(facts.where(_named()), 0, 0, hot).withColumns(_account_counts())
    alone = facts.where(~_named()).withColumn("n_demand", F.lit(0).cast("long"))
    parts = parts.select(*alone.columns).unionByName(alone)
    return parts.select(
        "bill_id",
        "period_start",
        "period_end",
        "bill_days",
        "kwh_usage",
        "kw_demand",
        "total_amount",
        "sales_tax_amount",
        "load_factor",
        "is_municipality",
        "is_holiday_month",
        (F.col("n_demand") > 0).alias("account_has_real_demand"),
        tokenize("bill_account", "ACCT", key).alias("account_token"),
    )


def _twice_median(values: Column) -> Column:
    """Sum of the two middle elements of an array (twice the same one if its size is odd)."""
    ordered, size = F.sort_array(values), F.size(values)
    return F.get(ordered, F.floor((size - 1) / 2).cast("int")) + F.get(ordered, F.floor(size / 2).cast("int"))


def _anomaly(test: Column, rule: str, fields: list[str], message: Column) -> Column:
    severity, risk = GRADES[rule]
    return F.when(
        test,
        F.struct(
            F.lit(rule).alias("rule_id"),
            F.lit(severity).alias("severity"),
            F.lit(risk).alias("is_overcharge_risk"),
            F.array(*[F.lit(f) for f in fields]).alias("field_names"),
            message.alias("message"),
        ),
    )


def _r1(
    window: int, min_prior: int, hi: float, lo: float, order: W
) -> tuple[dict[str, Column], dict[str, Column], list[Column]]:
    """Usage or charge against the median of the account's previous bills (its current and later bills excluded)."""
    before = order.rowsBetween(-window, -1)
    prepared = {
        "_prior": F.count(F.lit(1)).over(before),
        "_kwh_before": F.collect_list("kwh_usage").over(before),
        "_amount_before": F.collect_list("total_amount").over(before),
    }
    # Twice the median, so that decimals stay exact.
    derived = {"_kwh_twice": _twice_median(F.col("_kwh_before")), "_amount_twice": _twice_median(F.col("_amount_before"))}
    tests = []
    for field, twice, spike, drop, label in (
        ("kwh_usage", F.col("_kwh_twice"), R1_USAGE_SPIKE, R1_USAGE_DROP, "usage"),
        ("total_amount", F.col("_amount_twice"), R1_CHARGE_SPIKE, R1_CHARGE_DROP, "charge"),
    ):
        usable = (F.col("_prior") >= min_prior) & (twice > 0)
        value = F.col(field) * 2
        tests += [
            _anomaly(
                usable & (value >= twice * _factor(hi)), spike, [field],
                F.lit(f"{label} is at least {hi:g} times the median of the previous bills"),
            ),
            _anomaly(
                usable & (value <= twice * _factor(lo)), drop, [field],
                F.lit(f"{label} is at most {lo:g} times the median of the previous bills"),
            ),
        ]
    return prepared, derived, tests


def _factor(x: float) -> Column:
    return F.lit(x).cast("decimal(6,3)")


def _r2() -> Column:
    days = F.col("bill_days")
    return _anomaly(
        (days < 25) | (days > 35), R2_DAYS, ["bill_days"],
        F.concat(F.lit("bill covers "), days.cast("string"), F.lit(" days, outside 25-35")),
    )


def _r3() -> Column:
    kwh = (F.col("kwh_usage") <= 0) & ~F.col("is_holiday_month")
    test = F.coalesce(kwh, F.lit(False)) | F.coalesce(F.col("kw_demand") < 0, F.lit(False)) | F.coalesce(
        F.col("total_amount") < 0, F.lit(False)
    )
    return _anomaly(
        test, R3_VALUES, ["kwh_usage", "kw_demand", "total_amount"], F.lit("usage is zero or a value is negative")
    )


def _r4(share: float) -> Column:
    none = F.coalesce(F.col("sales_tax_amount"), F.lit(0)) == 0
    # Every bill is either taxed, untaxed or (negative tax) neither; the share is over all bills of the account.
    mostly = F.col("n_untaxed") > F.col("n_bills") * F.lit(share)
    return _anomaly(
        ~F.col("is_municipality") & none & (F.col("n_taxed") > 0) & mostly, R4_TAX, ["sales_tax_amount"],
        F.lit("account is taxed at times but most of its bills show no sales tax"),
    )


def _r5(pct: float, order: W) -> tuple[dict[str, Column], Column]:
    prepared = {
        "_load_before": F.lag("load_factor").over(order),
        "_demand_before": F.lag("kw_demand").over(order),
    }

    def swings(now: str, before: str) -> Column:
        change = F.abs(F.col(now) - F.col(before))
        return F.coalesce((F.col(before) > 0) & (change >= F.col(before) * F.lit(pct)), F.lit(False))

    test = (F.col("n_demand") > 0) & (swings("load_factor", "_load_before") | swings("kw_demand", "_demand_before"))
    message = f"load factor or demand changed by at least {pct * 100:g} percent against the previous bill"
    return prepared, _anomaly(test, R5_SWING, ["load_factor", "kw_demand"], F.lit(message))


def _r6(order: W) -> tuple[dict[str, Column], Column]:
    # Bills are ordered by period, so a repeated period is always next to its twin.
    prepared = {"_period_before": F.lag("period_end").over(order), "_period_after": F.lead("period_end").over(order)}
    end = F.col("period_end")
    test = F.coalesce(end == F.col("_period_before"), F.lit(False)) | F.coalesce(
        end == F.col("_period_after"), F.lit(False)
    )
    message = F.concat(F.lit("another bill of the account ends on "), end.cast("string"))
    return prepared, _anomaly(test, R6_DUPLICATE, ["period_start", "period_end"], message)


ALL_RULES = ("R1", "R2", "R3", "R4", "R5", "R6")


def detect_anomalies(
    bills: DataFrame,
    rules: tuple[str, ...] = ALL_RULES,
    window: int = 12,
    min_prior: int = 3,
    hi: float = 1.5,
    lo: float = 0.5,
    share: float = 0.5,
    pct: float = 0.5,
    hot: HotKeys = HotKeys(),
    dated: bool = False,
) -> DataFrame:
    """One row per finding: account, bill_id, rule_id, severity, is_overcharge_risk, field_names, message, status.

    Bills without account number have no history: only the rules on single bills (R2, R3) look at them. ``dated`` adds
    ``period_end`` of the bill.
    """
    facts = _facts(bills)
    order = _ordered()
    row_rules = {"R2": _r2, "R3": _r3}
    prepared, derived, tests = {}, {}, []
    if "R1" in rules:
        prepared, derived, tests = _r1(window, min_prior, hi, lo, order)
    tests += [rule() for name, rule in row_rules.items() if name in rules]
    if "R4" in rules:
        tests.append(_r4(share))
    if "R5" in rules:
        columns, found = _r5(pct, order)
        prepared, tests = {**prepared, **columns}, tests + [found]
    if "R6" in rules:
        columns, found = _r6(order)
        prepared, tests = {**prepared, **columns}, tests + [found]
    if set(rules) <= set(row_rules):
        parts = facts  # no history needed: no shuffle
    else:
        lookback = window if "R1" in rules else 1
        parts = _history(facts.where(_named()), lookback, 1 if "R6" in rules else 0, hot)
        parts = parts.withColumns({**_account_counts(), **prepared})
        parts = parts.where(~F.col("is_halo")).withColumns(derived)
    found = _found(parts, tests, dated)
    single = [rule() for name, rule in row_rules.items() if name in rules]
    if parts is not facts and single:
        found = found.unionByName(_found(facts.where(~_named()), single, dated))
    return found


def _named() -> Column:
    return F.trim(F.coalesce("bill_account", F.lit(""))) != ""


def _found(parts: DataFrame, tests: list[Column], dated: bool) -> DataFrame:
    kept = ["period_end"] if dated else []
    return (
        parts.select(
            F.col("bill_account").alias("account"), "bill_id", *kept, F.explode(F.array_compact(F.array(*tests))).alias("a")
        )
        .select("account", "bill_id", *kept, "a.*")
        .withColumn("status", F.lit("new"))
    )


def r1_spikes(
    bills: DataFrame, window: int = 12, min_prior: int = 3, hi: float = 1.5, lo: float = 0.5, hot: HotKeys = HotKeys()
) -> DataFrame:
    return detect_anomalies(bills, ("R1",), window, min_prior, hi, lo, hot=hot)


def r2_days(bills: DataFrame) -> DataFrame:
    return detect_anomalies(bills, ("R2",))


def r3_non_positive(bills: DataFrame) -> DataFrame:
    return detect_anomalies(bills, ("R3",))


def r4_tax(bills: DataFrame, share: float = 0.5, hot: HotKeys = HotKeys()) -> DataFrame:
    return detect_anomalies(bills, ("R4",), share=share, hot=hot)


def r5_swing(bills: DataFrame, pct: float = 0.5, hot: HotKeys = HotKeys()) -> DataFrame:
    return detect_anomalies(bills, ("R5",), pct=pct, hot=hot)


def r6_duplicates(bills: DataFrame, hot: HotKeys = HotKeys()) -> DataFrame:
    return detect_anomalies(bills, ("R6",), hot=hot)


def bill_anomalies(anomalies: DataFrame) -> DataFrame:
    """One row per bill with findings; ``anomalies`` is their JSON list (a bill has at most one per rule id)."""
    found = F.collect_list(F.struct("rule_id", "severity", "is_overcharge_risk", "field_names", "message"))
    return anomalies.groupBy("account", "bill_id").agg(F.to_json(F.array_sort(found)).alias("anomalies"))


def anomaly_summary(bills: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Per account: total_bills, bills_with_anomalies, total_anomalies."""
    per_bill = anomalies.groupBy("account", "bill_id").agg(F.count(F.lit(1)).alias("n"))
    found = per_bill.groupBy("account").agg(
        F.count(F.lit(1)).alias("bills_with_anomalies"), F.sum("n").alias("total_anomalies")
    )
    total = bills.groupBy(F.col("bill_account").alias("account")).agg(F.count(F.lit(1)).alias("total_bills"))
    zero = F.lit(0).cast("long")
    same = total["account"].eqNullSafe(found["account"])
    return total.join(found, same, "left").select(
        total["account"],
        "total_bills",
        F.coalesce("bills_with_anomalies", zero).alias("bills_with_anomalies"),
        F.coalesce("total_anomalies", zero).alias("total_anomalies"),
    )


def _ordinal() -> Column:
    """Place of a rule id among all rules."""
    return F.array_position(F.array(*[F.lit(r) for r in GRADES]), F.col("rule_id")) - 1


def validation_rows(anomalies: DataFrame, detected_on: Column) -> DataFrame:
    """Findings as rows of the validation-result table."""
    return anomalies.select(
        (F.col("bill_id") * len(GRADES) + _ordinal()).alias("id"),
        F.col("account").alias("account_id"),
        F.col("bill_id").alias("user_bill_id"),
        F.col("rule_id").alias("issue_type"),
        F.col("message").alias("description"),
        detected_on.alias("detected_on"),
        "status",
    )
