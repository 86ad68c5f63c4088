"""Table maintenance as pure functions: a new table from the old one and a set of changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattaudit.functions.values import month_start


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows of ``base`` with every changed key replaced by its latest change, new keys added.

    ``order`` (a column of the changes) says which change is the latest. Base and changes are aggregated together, so
    the copies of a hot key are combined before the shuffle.
    """
    columns = [c for c in base.columns if c not in keys]
    missing = [c for c in base.columns if c not in changes.columns and c != order]
    changes = changes.withColumns({c: F.lit(None).cast(base.schema[c].dataType) for c in missing})
    old = base.select(*keys, F.struct(*columns).alias("_row"), F.lit(0).alias("_new"), F.lit(None).alias("_at"))
    new = changes.select(*keys, F.struct(*columns).alias("_row"), F.lit(1).alias("_new"), F.col(order).alias("_at"))
    rows = old.withColumn("_at", F.col("_at").cast(new.schema["_at"].dataType)).unionByName(new)
    # Of changes that are equally late the greatest row wins, so that runs agree.
    latest = rows.groupBy(*keys).agg(F.max(F.struct("_new", "_at", "_row"))["_row"].alias("_row"))
    return latest.select(*keys, "_row.*").select(*base.columns)


def update_by_key(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``base`` with the non-null fields of ``changes`` put in; unknown keys are ignored.

    Of several changes of one key the greatest row (fields compared in their order) counts, so no row of ``base`` multiplies.
    """
    fields = [c for c in changes.columns if c != key]
    changes = changes.groupBy(key).agg(F.max(F.struct(*fields)).alias("_row")).select(key, "_row.*")
    joined = base.join(changes.withColumnsRenamed({c: f"_new_{c}" for c in fields}), key, "left")
    return joined.select(
        *[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns]
    )


def upsert_rates(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Monthly rates: a change replaces the newest row of its (type, class, month), which keeps its id.

    Dates of changes snap to the first of the month; changes without class, date or a rate above zero are skipped, and the last of
    several changes of one month (by ``seq``) wins. Older rows of that month stay as they are. New months get a null id
    (the table assigns it).
    """
    keys = ["rate_type", "sc_code", "_month"]
    entered = changes.where(
        (F.trim(F.coalesce("sc_code", F.lit(""))) != "") & F.col("effective_date").isNotNull() & (F.col("rate") > 0)
    ).select("rate_type", F.trim("sc_code").alias("sc_code"), month_start("effective_date").alias("_month"), "rate", "seq")
    latest = entered.groupBy(*keys).agg(F.max_by("rate", "seq").alias("_new_rate"))
    dated = base.withColumn("_month", month_start("effective_date"))
    newest = dated.groupBy(*keys).agg(F.max(F.struct("effective_date", "id")).alias("_top"))
    # One row per month of either side: the id to update, or null for an insert.
    targets = latest.join(newest, keys, "left").select(*keys, "_new_rate", F.col("_top.id").alias("_target"))
    updates = targets.where(F.col("_target").isNotNull()).select(
        "rate_type", F.col("_target").alias("id"), F.col("_month").alias("_date"), "_new_rate"
    )
    kept = base.join(updates, ["rate_type", "id"], "left").select(
        "rate_type",
        "id",
        F.coalesce("_date", "effective_date").alias("effective_date"),
        "sc_code",
        F.coalesce("_new_rate", "rate").alias("rate"),
    )
    added = targets.where(F.col("_target").isNull()).select(
        "rate_type",
        F.lit(None).cast(base.schema["id"].dataType).alias("id"),
        F.col("_month").alias("effective_date"),
        "sc_code",
        F.col("_new_rate").alias("rate"),
    )
    return kept.unionByName(added)
