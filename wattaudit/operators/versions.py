"""Tariff versions: validity intervals, the version in force for a bill, and the version register."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattaudit.functions.values import norm_sc
from wattaudit.operators.history import running
from wattaudit.operators.lookups import BROADCAST_ROWS, fits, join_counted, lookup_join
from wattaudit.operators.upserts import upsert

KEY = "norm_code"
#: Place of an undated version or bill behind all days.
_LAST_DAY = 1 << 32


def one_per_date(versions: DataFrame, key: str = KEY) -> DataFrame:
    """At most one version per class and date, the first one of the documents."""
    rest = [c for c in versions.columns if c not in (key, "effective_date")]
    origin = [F.col(c) for c in ("doc_id", "pos") if c in rest]
    first = F.min_by(F.struct(*rest), F.struct(*origin)) if origin else F.first(F.struct(*rest))
    return versions.groupBy(key, "effective_date").agg(first.alias("_v")).select(key, "effective_date", "_v.*")


def version_intervals(versions: DataFrame, fallback: bool = True, key: str = KEY) -> DataFrame:
    """Validity of each version: ``valid_from`` (included) to ``valid_to`` (excluded), null = open.

    A class has at most one version per date (the first one of the documents is kept), so the window per class holds no
    more rows than the calendar has days. With ``fallback`` the first version also covers all earlier bills. ``is_last``
    marks the version of a bill without date: an undated version if there is one, else the latest.
    """
    dated = one_per_date(versions, key)
    # An ascending sort puts undated versions first; they must come last.
    order = W.partitionBy(key).orderBy(F.col("effective_date").asc_nulls_last())
    place, after = F.row_number().over(order), F.lead("effective_date").over(order)
    undated = F.col("effective_date").isNull()
    opened = F.when(F.col("_place") > 1, F.col("effective_date")) if fallback else F.col("effective_date")
    return (
        dated.withColumns({"_place": place, "valid_to": after, "_next": F.lead(F.lit(1)).over(order)})
        .withColumns({"valid_from": opened, "is_last": F.col("_next").isNull()})
        # An undated version never covers a dated bill, unless it is the only fallback.
        .withColumn("covers_dates", ~undated | (F.lit(fallback) & (F.col("_place") == 1)))
        .drop("_place", "_next")
    )


def pick_version(
    bills: DataFrame,
    versions: DataFrame,
    fallback: bool = True,
    bill_class: Column | None = None,
    bill_date: Column | None = None,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """As-of join: add ``version`` (struct, null if none) in force for each bill.

    ``fallback``: a bill before the first version gets the first one and a bill without date the last one; otherwise
    (strict) both get none. Up to ``max_rows`` versions are broadcast as intervals; beyond that dates of bills and versions are put in
    one order and versions carried forward.
    """
    bills = bills.withColumns(
        {
            KEY: norm_sc("service_class") if bill_class is None else bill_class,
            "_date": F.coalesce("read_date", "bill_date") if bill_date is None else bill_date,
        }
    )
    if not fits(versions, max_rows):
        return _pick_carried(bills, versions, fallback)
    intervals = version_intervals(versions, fallback)
    rest = [c for c in intervals.columns if c not in (KEY, "valid_from", "valid_to", "is_last", "covers_dates")]
    dim = intervals.select(
        KEY, "valid_from", "valid_to", "is_last", "covers_dates", F.struct(*rest).alias("version")
    )
    date, low, high = F.col("_date"), F.col("valid_from"), F.col("valid_to")
    covers = (
        date.isNotNull() & F.col("covers_dates") & (low.isNull() | (low <= date)) & (high.isNull() | (date < high))
    )
    if fallback:
        covers = covers | (date.isNull() & F.col("is_last"))
    joined = lookup_join(bills, dim, [KEY], covers, "left", max_rows, spread=F.col("id"))
    return joined.drop("valid_from", "valid_to", "is_last", "covers_dates", "_date")


def _pick_carried(bills: DataFrame, versions: DataFrame, fallback: bool, width: int = 10_000) -> DataFrame:
    """``pick_version`` for any number of versions; ``bills`` have the columns KEY and ``_date``.

    Only the different (class, date) of the bills are looked for: together with the versions they are put in order of class and
    day, and the latest version is carried forward by blocks of days. A bill then meets the one row of its class and date.
    """
    dated = one_per_date(versions)
    fields = [c for c in dated.columns if c != KEY]
    day = F.coalesce(F.unix_date("effective_date").cast("long"), F.lit(_LAST_DAY))
    known = dated.select(F.col(KEY).alias("_code"), day.alias("_day"), F.struct(*fields).alias("version"))
    code = F.coalesce(F.col(KEY), F.lit(""))
    bills = bills.withColumns({"_code": code, "_day": F.coalesce(F.unix_date("_date").cast("long"), F.lit(_LAST_DAY))})
    asked = bills.groupBy("_code", "_day").agg(F.count(F.lit(1)).alias("_rows"))
    # A version comes before the bills of its own day. No day is later than an undated one.
    points = known.where(F.col("_day") < _LAST_DAY).select("_code", (2 * F.col("_day")).alias("_at"), F.col("_day").alias("_from"), F.lit(None).cast("long").alias("_rows"))
    points = points.unionByName(asked.select("_code", (2 * F.col("_day") + 1).alias("_at"), F.lit(None).cast("long").alias("_from"), "_rows"))
    carried = running(points, ["_code"], "_at", F.col("_from"), "_found", width=width).where(F.col("_rows").isNotNull())
    ends = known.groupBy("_code").agg(F.min("_day").alias("_first"), F.max("_day").alias("_last"))
    day = F.expr("(_at - 1) div 2")
    if fallback:
        found = F.when(day == _LAST_DAY, F.col("_last")).otherwise(F.coalesce("_found", "_first"))
    else:
        found = F.when(day < _LAST_DAY, F.col("_found"))
    resolved = carried.join(ends, "_code", "left").select("_code", day.alias("_day"), found.alias("_from"), "_rows")
    chosen = known.withColumnRenamed("_day", "_from")
    picked = resolved.join(chosen, ["_code", "_from"], "left").select("_code", "_day", "version", "_rows")
    return join_counted(bills, picked, ["_code", "_day"], "_rows").drop("_code", "_day", "_date")


def sc_codes(versions: DataFrame) -> DataFrame:
    """Distinct class codes in order."""
    return versions.select("sc_code").distinct().orderBy("sc_code")


def versions_of(versions: DataFrame, sc_code: str) -> DataFrame:
    """Effective dates of one class, newest first."""
    return versions.where(F.col("sc_code") == sc_code).select("effective_date").orderBy(F.desc("effective_date"))


def logic_of(versions: DataFrame, sc_code: str, date: str) -> DataFrame:
    """Logic of exactly this class and date."""
    return versions.where((F.col("sc_code") == sc_code) & (F.col("effective_date") == F.to_date(F.lit(date))))


def all_versions(versions: DataFrame) -> DataFrame:
    """Every version with its date as text."""
    return versions.withColumn("effective_date", F.date_format("effective_date", "yyyy-MM-dd"))


def code_mismatch(tariffs: DataFrame, expected: str = "section_code", found: str = "sc_code") -> DataFrame:
    """Tariffs whose class and the class of their text do not contain one another."""
    a, b = F.col(expected), F.coalesce(F.col(found), F.lit("UNKNOWN"))
    return tariffs.where(~(a.contains(b) | b.contains(a)))


def upsert_versions(register: DataFrame, changes: DataFrame) -> DataFrame:
    """Register of (sc_code, effective_date): a change replaces logic and document id; the latest change wins.

    The register has columns sc_code, effective_date, document_id, logic (JSON text without ``metadata``); changes also
    carry ``seq``, their order of arrival.
    """
    return upsert(register, changes, ["sc_code", "effective_date"], "seq")


def stored_logic(item: Column) -> Column:
    """JSON text of a tariff object without its ``metadata``."""
    fields = F.try_variant_get(item, "$", "map<string,variant>")
    return F.to_json(F.map_filter(fields, lambda k, _: k != "metadata"))


def upsert_documents(register: DataFrame, changes: DataFrame) -> DataFrame:
    """Register of documents by file name: metadata and upload date of the latest change."""
    return upsert(register, changes, ["filename"], "upload_date")
