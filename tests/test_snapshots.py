"""Stored tables as snapshots, and the incremental audit on them."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from wattaudit.operators import anomalies
from wattaudit.operators.history import HotKeys
from wattaudit.plans import incremental
from wattaudit.schemas import table as schema_of
from wattaudit.sources.snapshots import Conflict, SnapshotTable, retried

from conftest import plan, rows

SCHEMA = schema_of("id bigint, name string, status string")


@pytest.fixture
def stored(spark, tmp_path):
    return SnapshotTable(spark, str(tmp_path / "t"), SCHEMA, ["name"], buckets=5, most_folders=2)


def data(spark, *items):
    return spark.createDataFrame(list(items), "id long, name string, status string, seq int").drop("seq")


def test_empty_table(spark, stored):
    assert stored.snapshot().version == 0 and stored.read().count() == 0
    stored.append(data(spark))
    assert stored.snapshot().version == 1 and stored.read().count() == 0


def test_appended_ids_have_no_gaps_and_pieces_are_put_together(spark, stored):
    for part in range(5):
        stored.append(spark.range(40).repartition(3).select(F.lit(None).cast("long").alias("id"), F.concat(F.lit("n"), (F.col("id") % 7).cast("string")).alias("name"), F.lit(str(part)).alias("status")), "id")
    found = stored.read().collect()
    assert sorted(r.id for r in found) == list(range(200)) and stored.snapshot().next_id == 200
    assert {r.status for r in found if r.id < 40} == {"0"}
    assert max(len(f) for f in stored.snapshot().folders.values()) <= 2


def test_upsert_writes_only_touched_buckets(spark, stored):
    stored.load(data(spark, *[(i, f"n{i}", "old", 0) for i in range(50)], (99, None, "old", 0)), "id")
    before = stored.snapshot()
    changes = spark.createDataFrame([(None, "n3", "late", 2), (None, "n3", "early", 1), (None, None, "none", 1), (None, "new", "added", 1)], "id long, name string, status string, seq int")
    touched = stored.touched(changes)
    after = stored.upsert(changes, "seq")
    assert {b for b in after.folders if after.folders[b] != before.folders.get(b)} == set(touched) and len(touched) < 5
    got = {r.name: r.status for r in stored.read().collect()}
    assert len(got) == 52 and (got["n3"], got[None], got["new"], got["n4"]) == ("late", "none", "added", "old")
    assert stored.read(at=before).where("status = 'old'").count() == 51  # the old snapshot is still whole


def test_update_by_key(spark, tmp_path):
    stored = SnapshotTable(spark, str(tmp_path / "u"), SCHEMA, ["id"], buckets=4)
    stored.load(data(spark, *[(i, f"n{i}", "old", 0) for i in range(20)]))
    stored.update(spark.createDataFrame([(3, "new"), (3, None), (77, "new")], "id long, status string"))
    assert {r.id: r.status for r in stored.read().collect()} == {i: "new" if i == 3 else "old" for i in range(20)}


def test_a_killed_writer_leaves_the_old_snapshot(spark, stored, monkeypatch):
    stored.append(data(spark, (None, "a", "x", 0)), "id")
    monkeypatch.setattr(SnapshotTable, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        stored.append(data(spark, (None, "b", "x", 0)), "id")
    monkeypatch.undo()
    open(f"{stored.path}/manifest/_half-written", "w").close()
    assert rows(stored.read()) == [(0, "a", "x")]
    stored.append(data(spark, (None, "c", "x", 0)), "id")
    assert sorted(rows(stored.read())) == [(0, "a", "x"), (1, "c", "x")]


def test_vacuum_removes_what_no_kept_snapshot_names(spark, stored):
    stored.load(data(spark, *[(i, f"n{i}", "old", 0) for i in range(20)]), "id")
    before = stored.snapshot()
    changes = spark.createDataFrame([(None, f"n{i}", "new", 1) for i in range(20)], "id long, name string, status string, seq int")
    stored.upsert(changes, "seq")
    stored.append(data(spark, (None, "more", "x", 0)), "id")
    stored.staged(data(spark, (1, "left", "by a killed writer", 0)))
    assert stored.vacuum(1) == 0  # nothing is old enough
    want = sorted(rows(stored.read()), key=str)
    assert stored.vacuum(2, 0) > 0 and before.folders  # the two newest snapshots stay whole
    assert stored.read(at=stored._manifest(stored._manifests()[0])).count() == 20
    assert stored.vacuum(1, 0) > 0 and sorted(rows(stored.read()), key=str) == want
    named = {f for folders in stored.snapshot().folders.values() for f in folders}
    assert {f for f in os.listdir(f"{stored.path}/data") if not f.startswith(".")} == named
    with pytest.raises(ValueError, match="always kept"):
        stored.vacuum(0)


def test_of_two_writers_one_starts_again(spark, stored):
    other = SnapshotTable(spark, stored.path, SCHEMA, ["name"], buckets=5)
    tried = []

    def change():
        tried.append(1)
        at = stored.snapshot()
        if len(tried) == 1:  # the other one commits in between
            other.append(data(spark, (None, "b", "x", 0)), "id")
            stored.snapshot = lambda: at
        try:
            return stored.append(data(spark, (None, "a", "x", 0)), "id")
        finally:
            stored.__dict__.pop("snapshot", None)

    retried(change)
    assert len(tried) == 2 and sorted(rows(stored.read())) == [(0, "b", "x"), (1, "a", "x")]
    with pytest.raises(Conflict):
        stored._commit(stored.snapshot().__class__(), stored.snapshot())
    assert not [n for n in os.listdir(f"{stored.path}/manifest") if n.startswith("_")]


def uploads(spark):
    rng = random.Random(11)
    parts = []
    for part, accounts in enumerate((["a", "b", "c", None], ["b", "hot", " "], ["hot", "c", "d", None])):
        bills = []
        for i in range(60):
            account = rng.choice(accounts)
            day = dt.date(2020, 1, 1) + dt.timedelta(days=30 * rng.randrange(24))
            bills.append((account, "ACME", day, rng.choice([20, 30]), float(rng.choice([0, 100, 400])), rng.choice([0.0, 5.0, 20.0]), f"{rng.choice([10, 50, 90])}", rng.choice(["0", "1"]), part))
        parts.append(spark.createDataFrame(bills, "bill_account string, customer string, read_date date, days_used int, billed_kwh double, billed_demand double, bill_amount string, sales_tax_amt string, part int"))
    return parts


def test_incremental_findings_equal_a_full_run(spark, tmp_path):
    bills, findings = (f(spark, str(tmp_path), 8) for f in (incremental.bill_table, incremental.finding_table))
    hot = HotKeys(hot_rows=20, max_hot=1, chunk_rows=15, slab_ids=4)
    when = F.lit("2020-01-01").cast("timestamp")
    for n, part in enumerate(uploads(spark)):
        incremental.upload_bills(bills, part)
        if n == 1:
            continue  # this run was killed after the upload
        buckets = incremental.validate_new(bills, findings, when, hot)
        assert 0 < len(buckets) < 8
        got = sorted(rows(findings.read().drop("detected_on", "status")), key=str)
        full = anomalies.validation_rows(anomalies.detect_anomalies(bills.read()), when).drop("detected_on", "status")
        assert got == sorted(rows(full), key=str) and len({r[0] for r in got}) == len(got)
    assert incremental.validate_new(bills, findings) == []


def test_statuses_stay_and_other_buckets_are_not_read(spark, tmp_path):
    first, second, third = uploads(spark)
    bills, findings = (f(spark, str(tmp_path), 8) for f in (incremental.bill_table, incremental.finding_table))
    incremental.upload_bills(bills, first)
    incremental.validate_new(bills, findings, F.lit("2020-01-01").cast("timestamp"))
    closed = findings.read().where("account_id = 'b'").select("id", F.lit("closed").alias("status"))
    ids = {r.id for r in closed.collect()}
    findings.rewrite(list(range(8)), lambda old: old.withColumn("status", F.when(F.col("account_id") == "b", "closed").otherwise(F.col("status"))))
    before = findings.snapshot()
    incremental.upload_bills(bills, second)
    buckets = incremental.validate_new(bills, findings, F.lit("2021-01-01").cast("timestamp"))
    after = findings.snapshot()
    assert {b for b in range(8) if after.folders.get(b) != before.folders.get(b)} <= set(buckets)
    shown = plan(bills.read(buckets))
    assert all(f"bucket_no={b}" not in shown for b in range(8) if b not in buckets)
    found = findings.read().where("account_id = 'b'").collect()
    kept = [r for r in found if r.id in ids]
    assert kept and {(r.status, r.detected_on.year) for r in kept} == {("closed", 2020)}
    assert {(r.status, r.detected_on.year) for r in found if r.id not in ids} <= {("new", 2021)}
