from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from wattaudit.functions.tiers import tier_bounds
from wattaudit.operators import audits, pricing, rates, savings, versions
from wattaudit.sources import tariffs

from conftest import plan, rows

BILL = (
    "id long, bill_account string, service_class string, bill_date date, read_date date, days_used int, billed_kwh double,"
    " billed_demand double, billed_rkva double, bill_amount double, delivery_voltage_kv double"
)
D = Decimal


def bill(spark, *overrides):
    base = dict(
        id=1, bill_account="1", service_class="SC-1", bill_date=dt.date(2021, 4, 30), read_date=dt.date(2021, 4, 28),
        days_used=30, billed_kwh=100.0, billed_demand=10.0, billed_rkva=2.0, bill_amount=50.0, delivery_voltage_kv=None,
    )
    data = [tuple({**base, "id": i, **o}.values()) for i, o in enumerate(overrides or ({},))]
    return spark.createDataFrame(data, BILL)


def tariff(spark, *items):
    text = json.dumps({"tariffs": list(items)})
    return tariffs.tariff_versions(spark.createDataFrame([(1, text)], "doc_id long, body string"))


def version(*steps, sc="SC1", date="2020-01-01"):
    return {"sc_code": sc, "logic_steps": list(steps), "metadata": {"effective_date": date} if date else {}}


def step(kind, value=..., **more):
    out = {"step_name": kind, "charge_type": kind, **more}
    return out if value is ... else {**out, "value": value}


def price(spark, steps, *overrides, **options):
    return pricing.expected_bill(bill(spark, *overrides), tariff(spark, version(*steps)), **options).orderBy("id").collect()


def test_golden_bill(spark):
    """A customer charge and an energy rate: 19.00 + 8.18 = 27.18 against 28.26."""
    steps = [step("fixed_fee", 19.0), step("per_kwh", 0.08889)]
    r = price(spark, steps, {"billed_kwh": 92.0, "bill_amount": 28.26}, trace=True)[0]
    assert (r.expected_bill, r.variance, r.status) == (D("27.18"), D("1.08"), "SUCCESS")
    assert r.trace == ["fixed_fee: $19.00", "per_kwh: $8.18"]
    legacy = tariff(spark, version(step("fixed_fee", 19.0), step("formula", python_formula="user.billed_kwh * 0.08889")))
    b = bill(spark, {"service_class": "SC1", "billed_kwh": 92.0, "bill_amount": 28.26})
    old = pricing.expected_bill_legacy(b, legacy).first()
    assert (old.expected_bill, old.variance) == (D("27.18"), D("-1.08"))


@pytest.mark.parametrize(
    "kind, cost",
    [
        ("fixed_fee", 2), ("per_kwh", 200), ("energy_charge", 200), ("per_kw", 20), ("demand_charge", 20), ("per_rkva", 4),
        ("reactive_demand_fee", 4), ("minimum_monthly_charge", 0), ("demand_fee", 0), ("credit", 0), ("reference", 0),
    ],
)
def test_charge_types(spark, kind, cost):
    r = price(spark, [step(kind, 2)])[0]
    assert r.expected_bill == cost
    assert r.unpriced_steps == ([] if cost else [kind])


@pytest.mark.parametrize(
    "value, cost", [(5, 5), ("5", 5), ("$5", 0), ("prose", 0), (None, 0), (..., 0), ({}, 0), (0.5, D("0.50"))]
)
def test_step_values(spark, value, cost):
    assert price(spark, [step("fixed_fee", value)])[0].expected_bill == cost


TIERS = {"0-2.2 kV": 775, "2.2-15 kV": 850, "22-50 kV": 1430, "Over 60 kV": 1500}


@pytest.mark.parametrize("volts, cost", [(None, 0), (0.0, 775), (2.2, 775), (13.2, 850), (18.0, 0), (50.0, 1430), (60.0, 1500), (345.0, 1500)])
def test_tiers(spark, volts, cost):
    assert price(spark, [step("fixed_fee", TIERS)], {"delivery_voltage_kv": volts})[0].expected_bill == cost


@pytest.mark.parametrize(
    "label, low, high",
    [
        ("0-2.2 kV", 0.0, 2.2), ("Over 60 kV", 60.0, float("inf")), ("over 5", 5.0, float("inf")), ("13.2 kV", 13.2, 13.2),
        ("any", 0.0, float("inf")), ("Over", 0.0, float("inf")),
    ],
)
def test_tier_labels(spark, label, low, high):
    r = spark.range(1).select(tier_bounds(F.lit(label)).alias("t")).select("t.*").first()
    assert (r.low, r.high) == (low, high)


def test_minimum_is_the_largest_and_comes_last(spark):
    steps = [step("minimum_charge", 60), step("fixed_fee", 10), step("minimum_bill", 75)]
    r = price(spark, steps, trace=True)[0]
    assert r.expected_bill == 75 and r.trace == ["fixed_fee: $10.00", "Minimum bill enforced: $75.00"]
    assert price(spark, [*steps, step("per_kwh", 1)])[0].expected_bill == 110


def test_prose_minimum_fails_only_its_bills(spark):
    steps = [step("fixed_fee", 10), step("minimum_bill", "see contract", condition="user.billed_kwh > 500")]
    cheap, dear = price(spark, steps, {"billed_kwh": 1.0}, {"billed_kwh": 600.0})
    assert (cheap.status, cheap.expected_bill) == ("SUCCESS", 10)
    assert (dear.status, dear.expected_bill, dear.variance) == ("FAILED", None, None)


def test_condition_null_means_always_and_prose_never(spark):
    steps = [step("fixed_fee", 1, condition=None), step("fixed_fee", 2, condition="over 60 kV"), step("fixed_fee", 4, condition="")]
    assert price(spark, steps)[0].expected_bill == 1


def test_no_tariff_is_skipped_with_zero_variance(spark):
    r = price(spark, [step("fixed_fee", 1)], {"service_class": "SC9"}, trace=True)[0]
    assert (r.status, r.expected_bill, r.variance, r.trace) == ("SKIPPED", 0, 0, ["No tariff logic"])


def test_null_usage_counts_as_zero(spark):
    nothing = {"billed_kwh": None, "billed_demand": None, "billed_rkva": None, "days_used": 0, "bill_amount": None}
    steps = [step("per_kwh", 1), step("per_kw", 1), step("fixed_fee", 3, condition="user.days_used == 30")]
    r = price(spark, steps, nothing)[0]
    assert (r.expected_bill, r.actual_bill, r.variance) == (3, 0, -3)


def test_tariff_without_steps(spark):
    v = tariff(spark, {"sc_code": "SC1", "note": "canceled", "effective_date": "2009-04-27"})
    r = pricing.expected_bill(bill(spark), v).first()
    assert (r.status, r.expected_bill, r.variance) == ("SUCCESS", 0, 50)


RATE = "rate_type string, id long, effective_date date, sc_code string, rate decimal(18,6)"


def rate_table(spark, *data):
    return spark.createDataFrame([(t, i, dt.date.fromisoformat(e), sc, D(r)) for t, i, e, sc, r in data], RATE)


@pytest.mark.parametrize(
    "sc, rdm, line",
    [
        ("SC1", 20, "RDM Override (Energy): 0.20000 × 100.00 kWh = $20.00"),
        ("SC2-ND", 20, "RDM Override (Energy): 0.20000 × 100.00 kWh = $20.00"),
        ("SC3", 2, "RDM Override (Demand): 0.20000 × 10.00 kW = $2.00"),
        ("SC7", 0, None),
    ],
)
@pytest.mark.parametrize("max_rows", [0, 1000])
def test_overrides(spark, sc, rdm, line, max_rows):
    norm = {"SC2-ND": "SC2"}.get(sc, sc)
    table = rate_table(
        spark, ("tra", 1, "2021-04-02", norm, "0.01"), ("tra", 2, "2021-03-31", norm, "9"), ("rdm", 1, "2021-04-01", norm, "0.5"),
        ("rdm", 2, "2021-04-01", norm, "0.2"), ("sbc", 1, "2021-04-01", norm, "7"),
    )
    v = tariff(spark, version(step("fixed_fee", 10), sc=sc))
    r = pricing.expected_bill(
        bill(spark, {"service_class": sc}), v, table, {"SC2ND": "SC2"}, trace=True, detail=True, max_rows=max_rows
    ).first()
    assert r.expected_bill == 11 + rdm and (r.tra, r.rdm) == (D("0.01"), D("0.2"))
    want = ["fixed_fee: $10.00", "TRA Override: 0.01000 × 100.00 kWh = $1.00"]
    assert r.trace == want + ([line] if line else [])


def test_no_carry_forward_of_rates(spark):
    table = rate_table(spark, ("tra", 1, "2021-03-01", "SC1", "5"))
    r = pricing.expected_bill(bill(spark), tariff(spark, version(step("fixed_fee", 1))), table).first()
    assert r.expected_bill == 1


DATED = [version(step("fixed_fee", v), date=d) for v, d in ((1, "2000-01-01"), (2, "2010-06-15"), (3, "2020-01-01"))]


@pytest.mark.parametrize("max_rows", [0, 1000])
@pytest.mark.parametrize(
    "date, fallback, strict",
    [
        ("1990-01-01", 1, None), ("2000-01-01", 1, 1), ("2010-06-14", 1, 1), ("2010-06-15", 2, 2), ("2030-01-01", 3, 3),
        (None, 3, None),
    ],
)
def test_version_in_force(spark, date, fallback, strict, max_rows):
    day = dt.date.fromisoformat(date) if date else None
    b = bill(spark, {"read_date": day, "bill_date": day})
    v = tariff(spark, *reversed(DATED))
    for with_fallback, want in ((True, fallback), (False, strict)):
        got = versions.pick_version(b, v, with_fallback, max_rows=max_rows).collect()
        assert len(got) == 1
        fee = got[0].version and got[0].version.steps[0].number
        assert fee == want


@pytest.mark.parametrize("date, fee", [("1990-01-01", 1), ("2030-01-01", 3), (None, 9)])
def test_undated_version_is_last(spark, date, fee):
    day = dt.date.fromisoformat(date) if date else None
    v = tariff(spark, version(step("fixed_fee", 9), date=None), *DATED)
    r = pricing.expected_bill(bill(spark, {"read_date": day, "bill_date": day}), v).first()
    assert r.expected_bill == fee


def test_only_undated_version(spark):
    v = tariff(spark, version(step("fixed_fee", 9), date=None))
    assert pricing.expected_bill(bill(spark), v).first().expected_bill == 9


def test_read_date_comes_before_bill_date_except_in_the_audit(spark):
    b = bill(spark, {"read_date": dt.date(2010, 6, 14), "bill_date": dt.date(2010, 6, 16)})
    v = tariff(spark, *DATED)
    assert pricing.expected_bill(b, v).first().expected_bill == 1
    assert audits.audit(b, v).first().expected_bill == 2


def test_legacy_engine(spark):
    v = tariff(
        spark, version(step("fixed_fee", 1)), version(step("fixed_fee", 7), step("fixed_fee", "prose"), step("per_kwh", 1)),
        version(step("formula", python_formula="user.nothing * 2"), step("fixed_fee", 2), sc="SC-2"),
    )
    b = bill(spark, {"service_class": "SC1"}, {"service_class": "SC-1"}, {"service_class": None}, {"service_class": "SC-2"})
    got = [(r.sc_code, r.status, r.expected_bill) for r in pricing.expected_bill_legacy(b, v).orderBy("id").collect()]
    assert got == [("SC1", "SUCCESS", 7), ("SC-1", "SKIPPED", 0), ("SC1", "SUCCESS", 7), ("SC-2", "SUCCESS", 2)]


def test_audit_cleans_text_and_defaults_the_class(spark):
    b = spark.createDataFrame(
        [(1, "7", "4/28/21", "1,000", "-", "", "$1,234.56", "x"), (2, "8", "bad", "5", "1", "1", "1", "30")],
        "id long, bill_account string, bill_date string, billed_kwh string, billed_demand string, billed_rkva string,"
        " bill_amount string, days_used string",
    ).withColumn("read_date", F.lit(None).cast("date"))
    v = tariff(spark, version(step("per_kwh", 1), step("fixed_fee", 5, condition="user.days_used == 30")))
    got = {r.id: r for r in audits.audit(b, v).collect()}
    assert (got[1].actual_bill, got[1].expected_bill) == (D("1234.56"), D("1005.00"))
    assert got[2].bill_date is None and got[2].sc_code == "SC1"
    assert [r.id for r in audits.audit(b, v, account=" 7 ").collect()] == [1]


def test_summary_and_totals(spark):
    steps = [step("fixed_fee", 10)]
    audited = audits.audit(
        bill(spark, {"bill_amount": 10.05}, {"bill_amount": 10.06}, {"bill_amount": 1.0, "service_class": "SC9"}),
        tariff(spark, version(*steps)),
    )
    assert rows(audits.audit_summary(audited)) == [(3, D("0.11"), 1, 1)]
    assert rows(audits.report_totals(audited)) == [(D("21.11"), D("20.00"), D("0.11"))]
    assert {r.bill_account: r.total_bills for r in audits.audit_summary(audited, True).collect()} == {None: 3, "1": 3}


def test_report_layout(spark):
    b = bill(spark, {"bill_amount": 12.0}, {"bill_date": dt.date(2021, 3, 1), "service_class": "SC9"})
    audited = audits.audit(b, tariff(spark, version(step("fixed_fee", 10))), trace=True)
    lines = [r.line for r in audits.report_lines(audited, "now").orderBy("bill_no", "line_no").collect()]
    head = ["=" * 80, "BILL AUDIT REPORT", "=" * 80, "Account ID: 1", "Generated: now", "Total Bills Audited: 2", "=" * 80, ""]
    assert lines[:8] == head
    assert lines[8:12] == ["SUMMARY:", "  Total Variance: $2.00", "  High Variance Bills (>5%): 1", "  Calculation Errors: 1"]
    assert lines[17:28] == [
        "Bill #1:", "  Date: 2021-03-01", "  Service Class: SC9", "  Account: 1", "  Actual Amount: $50.00",
        "  Expected Amount: $0.00", "  Variance: $0.00", "  Status: SKIPPED", "  Calculation Trace:", "    - No tariff logic", "",
    ]
    assert lines[-3:] == ["=" * 80, "END OF REPORT", "=" * 80]


def test_savings(spark):
    v = tariff(spark, version(step("fixed_fee", 10)), version(step("fixed_fee", 4), sc="SC2"))
    b = bill(spark, {}, {"read_date": dt.date(2021, 5, 28)})
    old = pricing.expected_bill(b, v, detail=True)
    new = pricing.expected_bill(b.withColumn("service_class", F.lit("SC2")), v, detail=True)
    compared = savings.savings(old, new)
    assert sorted((str(r.bill_date), r.month, r.old_rate_bill, r.monthly_savings) for r in compared.collect()) == [
        ("2021-04-28", "04-28-21", D("10.00"), D("6.00")), ("2021-05-28", "05-28-21", D("10.00"), D("6.00"))
    ]
    assert rows(savings.savings_totals(compared)) == [(D("20.00"), D("8.00"), D("12.00"))]
    # Exports need no ids.
    assert savings.savings(old.drop("id"), new.drop("id")).count() == 2
    with pytest.raises(ValueError, match="Missing required"):
        savings.savings(old.drop("kwh"), new)


def test_price_plan_has_no_shuffle_of_bills_and_no_python(spark, tmp_path):
    path = str(tmp_path / "bills")
    bill(spark).write.parquet(path)
    stored = spark.read.parquet(path)
    v = tariff(spark, *DATED)
    shown = plan(pricing.expected_bill(stored, v, rate_table(spark, ("tra", 1, "2021-03-01", "SC1", "5"))))
    assert "Python" not in shown and "NestedLoop" not in shown and "Cartesian" not in shown
    assert shown.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in shown
    assert "customer" not in shown  # unused columns are not read


def test_large_dimension_is_not_broadcast_by_hint(spark):
    def optimized(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    # Versions are carried forward instead; other dimensions are salted.
    assert "strategy=broadcast" not in optimized(versions.pick_version(bill(spark), tariff(spark, *DATED), max_rows=0))
    known = rate_table(spark, ("tra", 1, "2021-03-01", "SC1", "5"))
    shown = optimized(rates.rates_for_bills(bill(spark), known, F.col("service_class"), F.col("read_date"), max_rows=0))
    assert "strategy=broadcast" not in shown and "_salt" in shown


def test_rates_grid_and_counts(spark):
    b = bill(spark, {"service_class": "SC1"}, {"service_class": "SC1", "read_date": None}, {"service_class": "SC3"})
    table = rate_table(spark, ("tra", 1, "2021-04-02", "SC1", "0.01"))
    grid = rates.override_grid(b, table, "SC-1")
    assert [(r.id, r.override_tra, r.override_rdm) for r in grid.collect()] == [(0, D("0.01"), D("0"))]
    kept, rejected = rates.entered_rates(rates.grid_rates(grid))
    assert kept.count() == 1 and rejected.count() == 3
    assert rows(rates.override_counts(grid)) == [("TRA", 1)]
