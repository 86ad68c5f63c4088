"""Incremental audit: after an upload only the accounts of the uploaded bills are validated again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattaudit.operators.anomalies import detect_anomalies, validation_rows
from wattaudit.operators.history import HotKeys
from wattaudit.operators.lookups import join_counted
from wattaudit.schemas import STORED_BILLS, VALIDATION_RESULTS
from wattaudit.sources.bills import stored_bills
from wattaudit.sources.snapshots import SnapshotTable, retried

#: Mark of the findings: bills with ids below it have been validated.
SEEN = "validated_bills"


def bill_table(spark: SparkSession, folder: str, buckets: int = 64) -> SnapshotTable:
    """Stored bills, dealt by account."""
    return SnapshotTable(spark, f"{folder.rstrip('/')}/bills", STORED_BILLS, ["bill_account"], buckets)


def finding_table(spark: SparkSession, folder: str, buckets: int = 64) -> SnapshotTable:
    """Stored findings, dealt by account into as many buckets as the bills."""
    return SnapshotTable(spark, f"{folder.rstrip('/')}/findings", VALIDATION_RESULTS, ["account_id"], buckets)


def _has_account(name: str) -> Column:
    return F.trim(F.coalesce(name, F.lit(""))) != ""


def upload_bills(table: SnapshotTable, bills: DataFrame) -> None:
    """Append bills; their ids follow on the highest one of the snapshot, and of two uploads at once one waits for the other."""
    typed = stored_bills(bills)
    retried(lambda: table.append(typed, "id"))


def validate_new(bills: SnapshotTable, findings: SnapshotTable, detected_on: Column | None = None, hot: HotKeys = HotKeys()) -> list[int]:
    """Bring the findings up to the newest bills; the buckets that were read and written are returned.

    The accounts of bills that are not validated yet are validated whole, from the buckets of those accounts; a bill without account
    is validated alone. Findings of these accounts are replaced: one that is found again keeps its time and its status, one that no longer
    holds goes. All others stay as they are. A run that was killed after the upload is made up for by the next one.
    """
    when = F.current_timestamp() if detected_on is None else detected_on
    at = bills.snapshot()
    seen = findings.snapshot().marks.get(SEEN, 0)
    if at.next_id <= seen:
        return []
    # Ids follow the order of uploads, so the scan skips the files of older ones by their statistics.
    fresh = bills.read(at=at).where(F.col("id") >= seen)
    buckets = bills.touched(fresh)
    stored = bills.read(buckets, at)
    counted = stored.where(_has_account("bill_account")).groupBy("bill_account").agg(F.count(F.lit(1)).alias("_rows"), F.max(F.col("id") >= seen).alias("_again"))
    # Written once: the accounts that are validated again, with the number of their bills.
    accounts = findings.staged(counted.where("_again"))
    known = join_counted(stored, accounts, ["bill_account"], "_rows")
    again = known.where(F.col("_again") | (F.col("id") >= seen)).drop("_again")
    found = validation_rows(detect_anomalies(again, hot=hot), when)

    def replaced(old: DataFrame) -> DataFrame:
        gone = accounts.select(F.col("bill_account").alias("account_id"), "_again")
        gone = gone.join(old.groupBy("account_id").agg(F.count(F.lit(1)).alias("_rows")), "account_id")
        marked = join_counted(old, gone, ["account_id"], "_rows")
        kept = marked.where("_again is null").drop("_again")
        # Ids say which rule found which bill, so they are the same whenever it is found; both sides meet in one aggregation.
        sides = marked.where("_again").drop("_again").withColumn("_new", F.lit(0)).unionByName(found.withColumn("_new", F.lit(1)))
        fields = [f for f in VALIDATION_RESULTS.fieldNames() if f != "id"]
        met = sides.groupBy("id").agg(
            F.max_by(F.struct(*fields), "_new").alias("row"), F.max("_new").alias("_new"),
            F.min_by(F.struct("detected_on", "status"), "_new").alias("before"),
        )
        held = met.where("_new = 1").select(
            "id", *[(F.col("before") if f in ("detected_on", "status") else F.col("row"))[f].alias(f) for f in fields]
        )
        return kept.unionByName(held.select(*kept.columns))

    retried(lambda: findings.rewrite(buckets, replaced, marks={SEEN: at.next_id}))
    return buckets
