from __future__ import annotations

import datetime as dt
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from wattaudit.functions import privacy, text, values
from wattaudit.operators import columns
from wattaudit.schemas import table

from conftest import rows


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "shown, date",
    [
        ("4/28/21", dt.date(2021, 4, 28)),
        ("04/28/1999", dt.date(1999, 4, 28)),
        ("1/2/99", dt.date(1999, 1, 2)),
        ("1/2/68", dt.date(2068, 1, 2)),
        ("1/2/69", dt.date(1969, 1, 2)),
        ("2021-04-28", dt.date(2021, 4, 28)),
        ("2021/4/28", dt.date(2021, 4, 28)),
        ("2021-04-28 10:00:00", dt.date(2021, 4, 28)),
        (" 4/28/2021 ", dt.date(2021, 4, 28)),
        ("13/45/2021", None),
        ("x", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_date(spark, shown, date):
    assert one(spark, values.parse_date, shown) == date


@pytest.mark.parametrize("shown, number", [("$1,234.56", 1234.56), ("-", None), ("", None), (None, None), ("-7", -7.0), ("nan", None)])
def test_clean_number(spark, shown, number):
    assert one(spark, values.clean_number, shown) == number
    assert one(spark, lambda c: values.clean_number(c, "zero"), shown) == (number or 0.0)


def test_clean_int_cuts_fractions(spark):
    assert one(spark, values.clean_int, "1,234.9") == 1234


@pytest.mark.parametrize("code, norm", [("sc-2 nd", "SC2ND"), (None, ""), (" SC1 ", "SC1")])
def test_norm_sc(spark, code, norm):
    assert one(spark, values.norm_sc, code) == norm


@pytest.mark.parametrize("name, flag", [("Town of X", True), ("National Electricity", True), ("Jones", False), ("", False), (None, False)])
def test_municipality(spark, name, flag):
    assert one(spark, values.is_municipality, name) is flag


def test_formats(spark):
    assert one(spark, values.money_text, "1234.5") == "$1,234.50"
    assert one(spark, values.int_text, "1234567") == "1,234,567"
    assert one(spark, values.int_text, "-") == ""
    assert one(spark, lambda c: values.trimmed_decimal(c, 2), "1,200.50") == "1200.5"
    assert one(spark, lambda c: values.trimmed_decimal(c, 2), "3.00") == "3"
    assert one(spark, lambda c: values.trimmed_decimal(c, 2), "n/a") == "n/a"
    assert one(spark, values.class_of_label, "SC-2 ND") == "SC2"
    assert one(spark, values.class_of_label, "SC-2") == "SC2D"


def test_nulls_and_bad_values(spark):
    df = spark.createDataFrame([(1, float("nan"), 1.0), (2, 2.0, float("inf")), (3, 3.0, 4.0)], "id int, a double, b double")
    assert rows(columns.nulls_only(df).orderBy("id")) == [(1, None, 1.0), (2, 2.0, None), (3, 3.0, 4.0)]
    assert [(r.id, r.bad_columns) for r in columns.bad_values(df, ["id"], 1).collect()] == [(1, ["a"])]


def test_conform(spark):
    df = spark.createDataFrame([("1", "x")], "kwh string, extra string")
    target = table("billed_kwh double, service_class string, retracted_amt double")
    out = columns.conform(df, target, {"kwh": "billed_kwh"}, {"service_class": "SC1"})
    assert rows(out) == [(1.0, "SC1", None)]
    with pytest.raises(ValueError, match=r"\['bill_date'\]"):
        columns.conform(df, target, required=("bill_date",))


def test_resolve_columns(spark):
    names = "`Date` string, kwh double, `KW Demand` double, amount_due double"
    df = spark.createDataFrame([("2020-01-01", 1.0, 2.0, 3.0)], names)
    assert columns.resolve_columns(text.clean_columns(df)) == {
        "bill_date": "date", "billed_kwh": "kwh", "billed_demand": "kw_demand", "bill_amount": "amount_due"
    }
    assert columns.as_bill_grid(df.drop("kwh")) is None
    assert rows(columns.as_bill_grid(df)) == [("2020-01-01", 1.0, 2.0, 3.0, None)]


def test_column_names():
    assert text.clean_name("  Bill Amount ($)") == "bill_amount"
    assert text.clean_name("  Bill Amount ", "strip") == "bill_amount"


@pytest.mark.parametrize("value", ["1120031219", " 1120031219 ", "é"])
@pytest.mark.parametrize("key", ["k", "x" * 100])
def test_token_is_hmac(spark, value, key):
    want = "ACCT_" + hmac.new(key.encode(), value.strip().encode(), hashlib.sha256).hexdigest()[:12]
    assert one(spark, lambda c: privacy.tokenize(c, "ACCT", key), value) == want


@pytest.mark.parametrize("value", [None, ""])
def test_token_of_nothing(spark, value):
    assert one(spark, lambda c: privacy.tokenize(c, "ACCT", "k"), value) == "ACCT_UNKNOWN"


def test_payload_keeps_null_fields_and_adds_optional_ones(spark):
    df = spark.createDataFrame(
        [(1, "7", None, None, 1.0, 2.0, 3.5, "", None), (2, "7", "SC1", dt.date(2020, 1, 2), 1.0, 2.0, 3.5, "12207", "m1")],
        "id long, bill_account string, service_class string, read_date date, billed_kwh double, billed_demand double,"
        " bill_amount double, zip string, meter string",
    )
    import json

    found = {r.id: json.loads(r.payload) for r in privacy.safe_payload(df, "k", zip_code="zip", meter="meter").collect()}
    assert found[1]["rate_schedule"] is None and found[1]["billing_period"] == {"start": None, "end": None}
    assert found[1]["charges"] == [] and "zip_code" not in found[1] and "meter_token" not in found[1]
    assert found[2]["zip_code"] == "12207" and found[2]["meter_token"].startswith("METER_")
    assert "bill_account" not in found[2] and "meter" not in found[2]
    assert "zip_code" not in json.loads(
        privacy.safe_payload(df, "k", zip_code="zip", include_zip=False).where("id = 2").first().payload
    )


def test_leaks_fail_the_job(spark):
    ok = spark.createDataFrame([('{"a":1}',)], "payload string")
    assert rows(privacy.assert_no_pii(ok)) == [('{"a":1}',)]
    bad = spark.createDataFrame([('{"a":1,"account_number":2}',)], "payload string")
    assert privacy.leaked_fields(bad).first().leaked == ["account_number"]
    with pytest.raises(Exception, match="forbidden fields: account_number"):
        privacy.assert_no_pii(bad).collect()
    with pytest.raises(ValueError):
        privacy.assert_no_pii(bad.withColumn("customer_name", F.lit("x")))


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("a\t b\n c ", "a b c"),
        ("１２３　ＡＢ c", "123 AB c"),
        (None, ""),
    ],
)
def test_norm_space(spark, raw, clean):
    assert one(spark, text.norm_space, raw) == clean
    assert one(spark, lambda c: text.norm_space(c, nfkc=True), raw) == clean


def test_full_normal_form(spark):
    assert one(spark, lambda c: text.norm_space(c, nfkc=True), "ﬁne ①") == "fine 1"


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("5A/1R2/1999", "5/12/1999"),
        ("1A0R/5/1999", "10/5/1999"),
        ("5 AB / 12/1999", "5/12/1999"),
        ("1/24/19951/22/1995", "1/24/1995 1/22/1995"),
        ("INC1/24/1995", "INC 1/24/1995"),
        ("INC.X1/24/1995", "INC.X 1/24/1995"),
        ("a 1120031219", "a\n\n1120031219"),
    ],
)
def test_repair_scan(spark, raw, clean):
    assert one(spark, text.repair_scan, raw) == clean


@pytest.mark.parametrize(
    "page, date",
    [
        ("Effective Date: 04/27/2009", dt.date(2009, 4, 27)),
        ("INITIAL EFFECTIVE DATE: SEPTEMBER  1, 2025 x", dt.date(2025, 9, 1)),
        ("initial effective date: april 27, 2009", dt.date(2009, 4, 27)),
        ("EFFECTIVE DATE: NOMONTH 1, 2025", None),
        ("none", None),
    ],
)
def test_effective_date(spark, page, date):
    assert one(spark, text.effective_date, page) == date


def test_tokens_and_names(spark):
    assert one(spark, text.sheet_name, "a/b:c  [d]") == "a b c d"
    assert one(spark, text.sheet_name, "") == "Results"
    assert len(one(spark, text.sheet_name, "x" * 40)) == 31
    assert one(spark, text.norm_caps, " a  b* c&d ") == "A B C&D"
    assert one(spark, text.token_kind, "$-1,234.50") == (False, False, False, True)
    assert one(spark, text.token_kind, "$5") == (False, False, False, True)
    assert one(spark, text.token_kind, "1,234") == (False, True, True, True)
    assert one(spark, text.token_kind, " 1/2/99 ").date


@pytest.mark.parametrize("shown, day", [
    ("Jan 5, 2021", "2021-01-05"), ("January 5 2021", "2021-01-05"), ("5-Jan-21", "2021-01-05"), ("05 SEP 1999", "1999-09-05"),
    ("5-Jan-70", "1970-01-05"), ("Janu 5, 2021", "2021-01-05"), ("Junk 5, 2021", None), ("Feb 30, 2021", None),
])
def test_dates_with_month_names(spark, shown, day):
    got = one(spark, values.parse_date, shown)
    assert (None if got is None else str(got)) == day
