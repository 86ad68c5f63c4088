from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal as D
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from wattaudit.functions import conditions
from wattaudit.functions.conditions import compile_condition, compile_formula, with_condition
from wattaudit.operators import pricing
from wattaudit.sources import tariffs

from conftest import plan

BILLS = [
    (900.0, 10.0, 4.0, 30, dt.date(2020, 7, 1), 2.2),
    (100.0, 0.0, 0.0, 28, dt.date(1996, 1, 31), None),
    (0.0, 55.5, 1.0, 36, dt.date(2021, 12, 15), 69.0),
]
SCHEMA = "billed_kwh double, billed_demand double, billed_rkva double, days_used int, bill_date date, delivery_voltage double"
TEXTS = [
    "Always",
    "user.billed_kwh > 800",
    "user.billed_kwh > 800 or user.billed_demand > 50",
    "not (user.billed_kwh > 800)",
    "user.bill_date.month in [6,7,8]",
    "user.bill_date.month not in (6, 7, 8)",
    "user.bill_date.year >= 2020 and user.bill_date.day == 15",
    "delivery_voltage <= 15 kV",
    "2.2 <= delivery_voltage < 60",
    "delivery_voltage > 1 or user.billed_kwh >= 0",
    "user.billed_kwh >= 0 or delivery_voltage > 1",
    "user.billed_kwh < 0 and delivery_voltage > 1",
    "min(user.billed_kwh, 500) / user.days_used >= 16",
    "max(user.billed_kwh, user.billed_demand, 200) == 200",
    "abs(user.billed_demand - 25) < 20",
    "round(user.billed_kwh / 7, 1) > 14.2",
    "user.billed_kwh % 7 == 2",
    "-user.billed_kwh // 7 == -15",
    "user.billed_kwh / user.billed_demand > 30",
    "user.billed_kwh",
    "user.days_used - 28",
    "1 < 2",
    "True",
    "",
    "Delivery voltage over 60 kV",
    "unknown > 1",
    "user.other > 1",
    "__import__('os')",
    "(lambda: 1)()",
    "user.billed_kwh.__class__",
    "user.billed_kwh >",
]


def reference(text, bill):
    """What evaluating the text as Python gives; any failure is false."""
    kwh, kw, rkva, days, date, volts = bill
    if text == "Always":
        return True
    user = SimpleNamespace(billed_kwh=kwh, billed_demand=kw, billed_rkva=rkva, days_used=days, bill_date=date)
    names = {"__builtins__": None, "min": min, "max": max, "abs": abs, "round": round}
    if "lambda" in text or "__" in text:
        return False  # never accepted here
    try:
        return bool(eval(text.replace(" kV", ""), names, {"user": user, "delivery_voltage": volts}))
    except Exception:
        return False


@pytest.mark.parametrize("text", TEXTS)
def test_condition_equals_python(spark, text):
    df = spark.createDataFrame(BILLS, SCHEMA)
    got = [r[0] for r in df.select(compile_condition(text)).collect()]
    assert got == [reference(text, b) for b in BILLS]


def test_missing_condition_always_holds(spark):
    assert spark.range(1).select(compile_condition(None)).first()[0] is True


def test_formula(spark):
    df = spark.createDataFrame(BILLS, SCHEMA)
    assert [r[0] for r in df.select(compile_formula("user.billed_kwh * 0.5 + 1")).collect()] == [451.0, 51.0, 1.0]
    assert [r[0] for r in df.select(compile_formula("user.billed_kwh / user.billed_demand")).collect()] == [90.0, None, 0.0]
    assert df.select(compile_formula("nonsense here")).first()[0] is None


def test_with_condition_compiles_each_text_once(spark):
    df = spark.createDataFrame(BILLS, SCHEMA).withColumn("condition", F.explode(F.array(*[F.lit(t) for t in TEXTS[:10]])))
    held = with_condition(df)
    for r in held.collect():
        bill = (r.billed_kwh, r.billed_demand, r.billed_rkva, r.days_used, r.bill_date, r.delivery_voltage)
        assert r.holds == reference(r.condition, bill), r


def test_many_templates_go_block_by_block(spark, monkeypatch):
    """Templates beyond the bound of one CASE give what one CASE gives."""
    texts = ["Always", None, "prose it is"] + [f"user.billed_kwh {op} {n} {j} user.days_used {op} {m}" for op in ("<", ">") for j in ("and", "or") for n in (10, 500) for m in (29, 31)]
    texts += ["user.billed_kwh " + "+ 1 " * i + "> 100" for i in range(9)]
    rows = [(i, t, float(k), 30, D("5.00"), dt.date(2021, 1, 9)) for i, (t, k) in enumerate((t, k) for t in texts for k in (5, 100, 900))]
    bills = spark.createDataFrame(rows, "id long, condition string, billed_kwh double, days_used int, bill_amount decimal(18,2), read_date date")
    bills = bills.withColumns({"billed_demand": F.lit(1.0), "billed_rkva": F.lit(1.0), "delivery_voltage_kv": F.lit(1.0), "bill_date": F.col("read_date")})
    want = {r.id: r.holds for r in conditions.with_condition(bills).collect()}
    monkeypatch.setattr(conditions, "MOST_TEMPLATES", 3)
    assert {r.id: r.holds for r in conditions.with_condition(bills).collect()} == want
    assert {want[3 * i] for i in range(len(texts))} == {True, False}

    class_of = {t: f"SC{i}" for i, t in enumerate(texts)}
    body = json.dumps([{"sc_code": class_of[t], "effective_date": "2020-01-01", "logic_steps": [{"step_name": "a", "charge_type": "fixed_fee", "value": 7} | ({} if t is None else {"condition": t})]} for t in texts])
    versions = tariffs.tariff_versions(spark.createDataFrame([(1, body)], "doc_id long, body string"))
    classes = spark.createDataFrame([(i, class_of[r[1]]) for i, r in enumerate(rows)] + [(9_999, "none")], "id long, service_class string")
    priced = pricing.expected_bill(bills.drop("condition").join(classes, "id", "right").withColumn("bill_account", F.lit("a")), versions)
    got = {r.id: (r.status, r.expected_bill) for r in priced.collect()}
    assert got == {**{i: ("SUCCESS", D("7.00") if h else D("0.00")) for i, h in want.items()}, 9_999: ("SKIPPED", D("0.00"))}


@pytest.mark.parametrize("small", [True, False])
def test_conditions_are_read_from_the_distinct_texts(spark, monkeypatch, small):
    """Shapes and numbers are taken from each different text once, not from every row, whether the texts fit a broadcast or not."""
    monkeypatch.setattr(conditions, "fits", lambda df: small, raising=False)
    df = spark.createDataFrame(BILLS, SCHEMA).withColumn("condition", F.explode(F.array(*[F.lit(t) for t in TEXTS[:10]], F.lit(None))))
    held = with_condition(df)
    assert "regexp" not in plan(held)
    assert held.columns == [*df.columns, "holds"] and held.count() == 11 * len(BILLS)
    for r in held.collect():
        bill = (r.billed_kwh, r.billed_demand, r.billed_rkva, r.days_used, r.bill_date, r.delivery_voltage)
        assert r.holds == (r.condition is None or reference(r.condition, bill)), r
