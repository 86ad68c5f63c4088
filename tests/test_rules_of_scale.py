"""What the verdict of the first round asked for: no caps, and the answers of the reference in the hard cases."""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from test_pricing import bill, price, step, tariff, version
from wattaudit.functions.conditions import numbers_of, template_of, with_condition
from wattaudit.operators import anomalies, audits, documents, issues, lookups, pricing, savings, upserts, usage
from wattaudit.operators.history import HotKeys
from wattaudit.session import work_dir
from wattaudit.sources import bills as bill_source


def day(text):
    return dt.date.fromisoformat(text)


def test_any_number_of_conditions_prices(spark):
    prose = [step("fixed_fee", 1, condition=f"Applies to customers of group {i}") for i in range(5_001)]
    real = [step("fixed_fee", 1, condition=f"user.billed_kwh > {i}") for i in range(5_001)]
    got = price(spark, [step("fixed_fee", 10), *prose, *real], {"billed_kwh": 2000.5})
    assert (got[0].expected_bill, got[0].status) == (D("2011.00"), "SUCCESS")


def test_very_many_condition_texts(spark):
    df = spark.range(100_000).select(
        F.concat(F.lit("user.billed_kwh > "), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, " and user.days_used >= 30").otherwise("")).alias("condition"),
        F.lit(500.5).alias("billed_kwh"), F.lit(29).alias("days_used"), F.lit(1.0).alias("billed_demand"), F.lit(1.0).alias("billed_rkva"),
        F.lit(day("2021-01-01")).alias("bill_date"), F.lit(2.0).alias("delivery_voltage"),
    )
    assert with_condition(df).where("holds").count() == 250


@pytest.mark.parametrize("text, template, numbers", [
    ("user.billed_kwh > 800", "user.billed_kwh > ?", [800.0]), ("Applies when demand exceeds 500 kW", None, [500.0]),
    ("2.2 < delivery_voltage < 60", "? < delivery_voltage < ?", [2.2, 60.0]), ("delivery_voltage <= 15 kV", "delivery_voltage <= ? kV", [15.0]),
    ("round(user.billed_kwh / 3, 0) == 1", "round(user.billed_kwh / 3, 0) == 1", [3.0, 0.0, 1.0]), ("user.billed_kwh > 007", "user.billed_kwh > 007", []),
    ("__import__('os').getcwd()", None, []),
])
def test_templates(spark, text, template, numbers):
    got = spark.range(1).select(template_of(F.lit(text)).alias("t"), numbers_of(F.lit(text)).alias("n")).first()
    assert got.t == template and got.n == numbers


def test_first_tier_in_the_order_of_the_tariff(spark):
    got = price(spark, [step("fixed_fee", {"Over 2 kV": 7, "0-15 kV": 3})], {"delivery_voltage_kv": 5.0}, {"delivery_voltage_kv": 1.0})
    assert [r.expected_bill for r in got] == [D("7.00"), D("3.00")]
    items = json.dumps([version(step("fixed_fee", {"b 0-9 kV": 1, "a 0-9 kV": 2}))])  # a bare list
    from wattaudit.sources import tariffs

    found = tariffs.tariff_versions(spark.createDataFrame([(1, items)], "doc_id long, body string")).first()
    assert [t.rate for t in found.steps[0].tiers] == [D(1), D(2)]


def test_small_rates_keep_their_digits(spark):
    got = price(spark, [step("per_kwh", 0.00000049)], {"billed_kwh": 1e7})
    assert got[0].expected_bill == D("4.90")


def test_second_name_of_the_voltage(spark):
    b = bill(spark, {"delivery_voltage_kv": 5.0}).withColumnRenamed("delivery_voltage_kv", "delivery_voltage")
    v = tariff(spark, version(step("fixed_fee", {"0-15 kV": 3})))
    assert pricing.expected_bill(b, v).first().expected_bill == D("3.00")


def test_stored_bills_are_priced(spark):
    path = work_dir(spark, "stored")
    given = bill(spark, {"service_class": None}, {"service_class": "SC-1"}).withColumn("raw_bill_document_id", F.lit(7))
    bill_source.append_bills(given, path)
    stored = bill_source.read_bills(spark, path)
    assert {(r.raw_bill_document_id, r.created_at is None) for r in stored.collect()} == {(7, False)}
    got = audits.audit(stored, tariff(spark, version(step("fixed_fee", 5)))).collect()
    assert {(r.sc_code, r.status, r.expected_bill) for r in got} == {("SC1", "SUCCESS", D("5.00"))}


BILLS = (
    "id long, bill_account string, customer string, read_date date, days_used int, billed_kwh double, billed_demand double,"
    " bill_amount double, sales_tax_amt double, load_factor double"
)


def history(spark, *accounts):
    return spark.createDataFrame([(i, a, "c", day("2021-01-01"), 10, 1.0, 1.0, 1.0, 0.0, 0.5) for i, a in enumerate(accounts)], BILLS)


def test_bills_without_account_are_not_compared(spark):
    b = history(spark, None, None, "", "1", "1")
    found = anomalies.detect_anomalies(b, dated=True).collect()
    assert {r.bill_id for r in found if r.rule_id == anomalies.R6_DUPLICATE} == {3, 4}
    assert {r.bill_id for r in found if r.rule_id == anomalies.R2_DAYS} == {0, 1, 2, 3, 4}
    facts = {r.bill_id: r.account_has_real_demand for r in anomalies.qc_facts(b, "k").collect()}
    assert facts == {0: False, 1: False, 2: False, 3: True, 4: True}


def test_more_hot_accounts_than_are_broadcast(spark):
    b = history(spark, *[str(i % 9) for i in range(90)])
    b = b.withColumn("read_date", F.date_add("read_date", (F.col("id") / 9).cast("int") % 7)).withColumn("billed_kwh", 1.0 + F.col("id") % 5)
    key = lambda df: sorted(map(str, df.collect()))
    want = key(anomalies.detect_anomalies(b))
    for most in (2, 100):
        assert key(anomalies.detect_anomalies(b, hot=HotKeys(hot_rows=3, max_hot=most, chunk_rows=13, slab_ids=4))) == want


def test_totals_are_told_from_null_keys(spark):
    calls = spark.createDataFrame(
        [(None, "op", "a", True, 1, 1), (dt.datetime(2021, 1, 1), "op", None, False, 1, 1)],
        "ts timestamp, kind string, key string, success boolean, input_tokens long, output_tokens long",
    )
    got = {(r.month, r.operation, r.is_total, r.requests) for r in usage.op_usage(calls).collect()}
    assert got == {(None, "a", False, 1), (None, None, True, 1), ("2021-01", None, False, 1), ("2021-01", None, True, 1)}
    b = bill(spark, {"bill_account": None}, {"bill_account": "1"})
    totals = audits.audit_summary(audits.audit(b, tariff(spark, version(step("fixed_fee", 5)))), by_account=True).collect()
    assert {(r.bill_account, r.is_total, r.total_bills) for r in totals} == {(None, False, 1), ("1", False, 1), (None, True, 2)}


def test_rates_above_zero_only(spark):
    base = spark.createDataFrame([], "rate_type string, id long, effective_date date, sc_code string, rate decimal(18,6)")
    rows = [("tra", "SC1", day("2021-01-05"), D(r), i) for i, r in enumerate(("-1", "0"))] + [("tra", "SC2", day("2021-01-05"), D("0.1"), 9)]
    changes = spark.createDataFrame(rows, "rate_type string, sc_code string, effective_date date, rate decimal(18,6), seq int")
    assert [r.sc_code for r in upserts.upsert_rates(base, changes).collect()] == ["SC2"]


def test_repeated_changes_multiply_nothing(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    changes = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "id long, v string")
    assert sorted(map(tuple, upserts.update_by_key(base, changes, "id").collect())) == [(1, "y"), (2, "b")]
    equal = spark.createDataFrame([(1, "x", 5), (1, "y", 5)], "id long, v string, seq int")
    assert sorted(map(tuple, upserts.upsert(base, equal, ["id"], "seq").collect())) == [(1, "y"), (2, "b")]


def test_savings_need_an_account(spark):
    b = bill(spark, {}, {"bill_account": "2"}).select("bill_account", "bill_date", "billed_kwh", "billed_demand", "bill_amount")
    assert savings.savings(b, b).count() == 2
    assert savings.savings(b.union(b), b).count() == 4  # a date that occurs twice meets both times
    with pytest.raises(ValueError):
        savings.savings(b, b, on=())


def test_one_row_per_token(spark, monkeypatch):
    monkeypatch.setattr(documents, "tokenize", lambda c, kind, key: F.concat(F.lit("T"), F.length(c).cast("string")))
    b = spark.createDataFrame([("11",), ("22",), ("333",)], "bill_account string")
    none = spark.createDataFrame([], "token string, account_number string")
    assert sorted(map(tuple, documents.token_map(b, none, "k").collect())) == [("T2", "11"), ("T3", "333")]
    assert [r.account_number for r in documents.token_collisions(b, none, "k").collect()] == ["22"]


def test_limits_are_asked_for(spark):
    found = spark.range(150).selectExpr("id", "date'2021-01-01' AS detected_on", "'new' AS status")
    assert issues.validation_results(found).count() == 150 and issues.validation_results(found, limit=100).count() == 100


def test_broadcast_is_bounded_by_bytes(spark):
    wide = spark.range(3).withColumn("t", F.repeat(F.lit("x"), 1000))
    assert lookups.fits(wide, 10) and not lookups.fits(wide, 10, max_bytes=2000)
