"""As-of and range joins beyond the broadcast bounds."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wattaudit.operators import tiers, versions
from wattaudit.operators.lookups import join_counted, lookup_join

from conftest import plan, rows


def day(n):
    return dt.date(1990, 1, 1) + dt.timedelta(days=n)


def random_tables(spark, seed):
    rng = random.Random(seed)
    known = [(i, 0, rng.choice(["SC1", "SC2", "SC3"]), day(rng.randrange(60)) if rng.random() < 0.9 else None, f"v{i}") for i in range(40)]
    known += [(50, 0, "SC9", None, "only undated"), (51, 0, "SC3", day(5), "x"), (52, 0, "SC3", day(5), "y")]
    table = spark.createDataFrame(known, "doc_id long, pos int, norm_code string, effective_date date, name string")
    bills = [(i, rng.choice(["SC1", "SC2", "SC-3", "sc9", "none", None]), day(rng.randrange(-9, 70)) if rng.random() < 0.9 else None) for i in range(300)]
    return spark.createDataFrame(bills, "id long, service_class string, read_date date").withColumn("bill_date", F.col("read_date")), table


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_carried_versions_equal_the_intervals(spark, fallback, seed):
    bills, known = random_tables(spark, seed)
    out = ["id", "norm_code", "version.effective_date", "version.name"]
    want = versions.pick_version(bills, known, fallback).select(*out)
    got = versions.pick_version(bills, known, fallback, max_rows=0).select(*out)
    assert sorted(map(str, rows(got))) == sorted(map(str, rows(want)))


def test_a_million_versions_of_one_class(spark):
    known = spark.range(1_000_000).select(
        F.lit("SC1").alias("norm_code"), F.date_add(F.lit("1000-01-01").cast("date"), F.col("id").cast("int")).alias("effective_date"), F.col("id").alias("no")
    )
    bills = spark.range(20_000).select("id", F.lit("SC1").alias("service_class"), F.date_add(F.lit("1000-01-01").cast("date"), (F.col("id") * 60).cast("int")).alias("read_date"))
    picked = versions.pick_version(bills.withColumn("bill_date", F.col("read_date")), known)
    assert picked.count() == 20_000
    assert picked.where(F.col("version.no") == F.least(F.col("id") * 60, F.lit(999_999))).count() == 20_000


def test_join_counted_keeps_hot_and_unmatched_rows(spark):
    left = spark.range(30_000).select(F.when(F.col("id") < 20_000, 7).otherwise(F.col("id") % 50).cast("long").alias("k"), "id")
    right = left.where("k <> 3").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    got = join_counted(left, right, ["k"], "n")
    assert got.count() == 30_000 and got.where("top is null").count() == left.where("k = 3").count()
    assert got.columns == ["k", "id", "top"] and "BroadcastHashJoin" in plan(got)


def test_step_rates(spark):
    step = "array<struct<step_name:string,charge_type:string,number:decimal(24,12),tiers:array<struct<low:double,high:double,rate:decimal(24,12)>>>>"
    known = spark.createDataFrame([(0, 0, "SC1", day(0)), (1, 0, "SC2", day(0))], "doc_id long, pos int, norm_code string, effective_date date")
    inf = float("inf")
    tiered = [(0.0, 5.0, 1), (5.0, 25.0, 2), (20.0, 2_000.0, 3), (60.0, inf, 4), (9.0, 8.0, 9)]
    literal = F.array(
        F.struct(F.lit("flat").alias("step_name"), F.lit("fixed_fee").alias("charge_type"), F.lit(7).alias("number"), F.lit(None).alias("tiers")),
        F.struct(F.lit("tiered").alias("step_name"), F.lit("per_kw").alias("charge_type"), F.lit(None).alias("number"),
                 F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), F.lit(r).alias("rate")) for a, b, r in tiered]).alias("tiers")),
    ).cast(step)
    known = known.withColumn("steps", F.when(F.col("norm_code") == "SC1", literal).otherwise(F.array().cast(step)))
    volts = [0.0, 5.0, 5.1, 22.0, 25.5, 999.0, 1_500.0, 5_000.0, None, -3.0, float("nan"), inf]
    bills = spark.createDataFrame([(i, c, day(1), v) for i, v in enumerate(volts) for c in ("SC1", "SC2", "SC4")], "id long, service_class string, read_date date, delivery_voltage_kv double")
    picked = versions.pick_version(bills.withColumn("bill_date", F.col("read_date")), known)
    found = {(r.id, r.step_name): float(r.rate) for r in tiers.step_rates(picked, known).collect()}
    want = [1, 1, 2, 2, 3, 3, 3, 4, 0, 0, 0, 4]
    assert found == {(i, n): float(x) for i, w in enumerate(want) for n, x in (("flat", 7), ("tiered", w))}


def test_copies_of_a_large_dimension_are_not_broadcast(spark):
    dim = spark.range(100).select("id", F.concat(F.lit("n"), "id").alias("name"))
    facts = spark.range(1_000).select(F.col("id").alias("fact"), (F.col("id") % 150).alias("id"))
    joined = lookup_join(facts, dim, ["id"], max_rows=10, spread=F.col("fact"))
    assert "BroadcastHashJoin" not in plan(joined)
    assert set(rows(joined.select("fact", "id", "name"))) == {(i, i % 150, f"n{i % 150}" if i % 150 < 100 else None) for i in range(1_000)}
    assert joined.count() == 1_000
