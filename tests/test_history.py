"""Hot accounts cut into chunks give what one window per account gives."""

from __future__ import annotations

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from wattaudit.operators import anomalies, audits
from wattaudit.operators.history import HotKeys, cut, hot_keys, positions, profile, running

from conftest import rows

SCHEMA = (
    "id long, bill_account string, customer string, read_date date, days_used int, billed_kwh double, billed_demand double,"
    " load_factor double, bill_amount decimal(18,2), sales_tax_amt decimal(18,2)"
)
# Everything is hot, chunks and slabs are tiny.
TINY = HotKeys(hot_rows=3, max_hot=50, chunk_rows=13, slab_ids=4)
COLD = HotKeys()


def history(seed: int, n: int = 400):
    rng = random.Random(seed)
    out = []
    from decimal import Decimal

    for i in range(n):
        # One account holds a third of all rows; many of its bills share a day.
        account = "hot" if rng.random() < 0.34 else rng.choice([None, f"a{rng.randrange(25)}", f"a{rng.randrange(25)}"])
        day = dt.date(2020, 1, 1) + dt.timedelta(days=rng.choice([0, 0, 0, rng.randrange(700)]))
        out.append(
            (
                i * 3 + rng.randrange(3), account, "TOWN" if account == "a3" else "X", None if rng.random() < 0.03 else day,
                rng.randrange(22, 40), rng.choice([0.0, 100.0, 150.0, 300.0, 75.0]), rng.choice([0.0, 5.0, 9.0]) if account != "a5" else 0.0,
                rng.choice([0.1, 0.2, 0.5, None]), Decimal(rng.randrange(-50, 5000)) / 100,
                rng.choice([None, Decimal(0), Decimal("1.20")]),
            )
        )
    return out


@pytest.fixture(scope="module", params=[1, 2])
def bills(request, spark):
    data = history(request.param)
    return data, spark.createDataFrame(data, SCHEMA).cache()


def ordered(data):
    accounts = {}
    for b in sorted(data, key=lambda b: (b[3] or dt.date.min, b[0])):
        accounts.setdefault(b[1], []).append(b)
    return accounts


def test_positions_are_exact(bills):
    data, df = bills
    large = hot_keys(profile(df, "bill_account", "id"), "bill_account", HotKeys(hot_rows=0, max_hot=99))
    keyed = df.withColumn("_key", F.coalesce("bill_account", F.lit("\0")))
    got = positions(keyed.join(large, "_key"), "read_date", "id", TINY)
    want = {b[0]: i for a in ordered(data).values() for i, b in enumerate(a)}
    assert {r.id: r.position for r in got.collect()} == want


def test_chunks_hold_every_row_once_and_enough_neighbours(bills):
    data, df = bills
    parts = cut(df, "bill_account", "read_date", "id", profile(df, "bill_account", "id"), 5, 2, TINY).collect()
    own = [r for r in parts if not r.is_halo]
    assert sorted(r.id for r in own) == sorted(b[0] for b in data)
    present = {(r.bill_account, r.chunk, r.id) for r in parts}
    chunk_of = {r.id: r.chunk for r in own}
    for account, items in ordered(data).items():
        for i, b in enumerate(items):
            for other in items[max(0, i - 5) : i + 3]:
                assert (account, chunk_of[b[0]], other[0]) in present
    assert max(sum(1 for r in own if (r.bill_account, r.chunk) == k) for k in {(r.bill_account, r.chunk) for r in own}) <= 13


def brute(data):
    """Bills without account are no history of one another: only the rules on single bills look at them."""
    found = set()
    histories = [items for account, items in ordered(data).items() if account is not None]
    histories += [[b] for b in data if b[1] is None]
    for items in histories:
        has_demand = any(b[6] > 0 for b in items)
        taxed = [b for b in items if (b[9] or 0) > 0]
        untaxed = [b for b in items if (b[9] or 0) == 0]
        for i, b in enumerate(items):
            hit = lambda rule: found.add((b[1], b[0], rule))
            prior = items[max(0, i - 12) : i]
            if len(prior) >= 3:
                usage = statistics.median(p[5] for p in prior)
                charge = statistics.median(p[8] for p in prior)
                if usage > 0 and b[5] >= 1.5 * usage:
                    hit(anomalies.R1_USAGE_SPIKE)
                if usage > 0 and b[5] <= 0.5 * usage:
                    hit(anomalies.R1_USAGE_DROP)
                if charge > 0 and 2 * b[8] >= 3 * charge:
                    hit(anomalies.R1_CHARGE_SPIKE)
                if charge > 0 and 2 * b[8] <= charge:
                    hit(anomalies.R1_CHARGE_DROP)
            if not 25 <= b[4] <= 35:
                hit(anomalies.R2_DAYS)
            if b[5] <= 0 or b[6] < 0 or b[8] < 0:
                hit(anomalies.R3_VALUES)
            if b[2] != "TOWN" and (b[9] or 0) == 0 and taxed and 2 * len(untaxed) > len(items):
                hit(anomalies.R4_TAX)
            if i and has_demand:
                before = items[i - 1]
                for f in (6, 7):
                    if b[f] is not None and (before[f] or 0) > 0 and abs(b[f] - before[f]) >= 0.5 * before[f]:
                        hit(anomalies.R5_SWING)
            if b[3] is not None and sum(o[3] == b[3] for o in items) > 1:
                hit(anomalies.R6_DUPLICATE)
    return found


@pytest.mark.parametrize("hot", [TINY, COLD, HotKeys(hot_rows=3, max_hot=1, chunk_rows=12, slab_ids=1000)])
def test_anomalies_equal_brute_force(bills, hot):
    data, df = bills
    got = anomalies.detect_anomalies(df, hot=hot).select("account", "bill_id", "rule_id").collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute(data)


def test_summary_counts_every_account(bills):
    data, df = bills
    got = anomalies.anomaly_summary(df, anomalies.detect_anomalies(df, hot=TINY)).collect()
    hits = brute(data)
    want = {
        account: (len(items), len({h[1] for h in hits if h[0] == account}), sum(h[0] == account for h in hits))
        for account, items in ordered(data).items()
    }
    assert {r.account: tuple(r)[1:] for r in got} == want


@pytest.mark.parametrize("rule", ["r1_spikes", "r4_tax", "r5_swing", "r6_duplicates"])
def test_single_rules_are_parts_of_the_detector(bills, rule):
    _, df = bills
    prefix = {"r1_spikes": "R1", "r4_tax": "R4", "r5_swing": "R5", "r6_duplicates": "R6"}[rule]
    alone = getattr(anomalies, rule)(df, hot=TINY)
    together = anomalies.detect_anomalies(df).where(F.col("rule_id").startswith(prefix))
    assert sorted(map(str, rows(alone))) == sorted(map(str, rows(together)))


def test_facts_of_hot_accounts(bills):
    data, df = bills
    got = {r.bill_id: r.account_has_real_demand for r in anomalies.qc_facts(df, "k", TINY).collect()}
    want = {b[0]: b[1] is not None and any(o[6] > 0 for o in items) for items in ordered(data).values() for b in items}
    assert got == want


def test_bill_numbers_of_hot_accounts(bills):
    data, df = bills
    got = audits.bill_numbers(df.withColumn("bill_date", F.col("read_date")), TINY)
    want = {b[0]: i + 1 for items in ordered(data).values() for i, b in enumerate(items)}
    assert {r.id: r.bill_no for r in got.collect()} == want


def test_hashed_ids_share_slabs(spark):
    """Ids spread over the whole range of longs: slabs grow with the range, positions stay exact."""
    rng = random.Random(5)
    data = [(rng.randrange(-(2**62), 2**62), "h", dt.date(2020, 1, 1)) for _ in range(300)]
    df = spark.createDataFrame(data, "id long, bill_account string, read_date date")
    numbers = audits.bill_numbers(df.withColumn("bill_date", F.col("read_date")), TINY)
    want = {r[0]: i + 1 for i, r in enumerate(sorted(data))}
    assert {r.id: r.bill_no for r in numbers.collect()} == want


@pytest.mark.parametrize("width", [1, 7, 10_000])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("kind", ["last", "sum"])
def test_running_equals_a_plain_scan(spark, width, descending, inclusive, kind):
    rng = random.Random(3)
    data = [(k, o, rng.choice([None, rng.randrange(9)])) for k in "ab" for o in rng.sample(range(100), 40)]
    df = spark.createDataFrame(data, "k string, o int, v int")
    got = running(df, ["k"], "o", F.col("v"), "out", kind, inclusive, descending, width)
    want = {}
    for key in "ab":
        state = 0 if kind == "sum" else None
        for k, o, v in sorted((r for r in data if r[0] == key), key=lambda r: r[1], reverse=descending):
            before = state
            if v is not None:
                state = state + v if kind == "sum" else v
            want[k, o] = state if inclusive else before
    assert {(r.k, r.o): r.out for r in got.collect()} == want
