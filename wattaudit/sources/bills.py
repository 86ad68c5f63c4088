"""The bill table: scan and append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattaudit.operators.columns import as_date, as_number, conform
from wattaudit.schemas import BILLS, STORED_BILLS


def of_account(bills: DataFrame, account: str | None) -> DataFrame:
    """All bills, or those of one account (its number is trimmed)."""
    return bills if account is None else bills.where(F.col("bill_account") == account.strip())


def read_bills(spark: SparkSession, path: str, account: str | None = None) -> DataFrame:
    """Stored bills; the account filter reaches the Parquet scan."""
    return of_account(spark.read.schema(STORED_BILLS).parquet(path), account)


def read_bills_jdbc(
    spark: SparkSession, url: str, table: str, lowest_id: int, highest_id: int, partitions: int, account: str | None = None
) -> DataFrame:
    """Bills of a relational database, read in parallel by ranges of the id."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn="id", lowerBound=lowest_id, upperBound=highest_id,
        numPartitions=partitions,
    )
    return of_account(reader.load(), account)


def with_voltage(df: DataFrame) -> DataFrame:
    """``delivery_voltage`` is another name of ``delivery_voltage_kv``."""
    if "delivery_voltage" not in df.columns or "delivery_voltage_kv" in df.columns:
        return df
    return df.withColumnRenamed("delivery_voltage", "delivery_voltage_kv")


def typed_bills(df: DataFrame, *keep: str) -> DataFrame:
    """Bill columns in stored order, then the columns ``keep`` as they are; missing ones are null, dates and numbers are read leniently, bad ones become null."""
    casts = {}
    for field in BILLS.fields:
        kind = field.dataType.simpleString()
        if field.name not in df.columns:
            continue
        if kind == "date":
            casts[field.name] = as_date(df, field.name)
        elif kind == "int":
            casts[field.name] = as_number(df, field.name).try_cast("int")
        elif kind != "string":
            casts[field.name] = as_number(df, field.name, kind)
    schema = T.StructType([*BILLS.fields, *[df.schema[name] for name in keep]])
    return conform(df, schema, casts={**casts, **{name: F.col(name) for name in keep}})


def stored_bills(df: DataFrame) -> DataFrame:
    """Bills with the columns of the stored table, not numbered yet.

    The document a bill comes from, its class and its voltage (under either name) are kept; ``created_at`` is the time of
    the append unless the bills have one. Bills are never deduplicated; R6 finds repeated ones.
    """
    df = with_voltage(df)
    kept = {f.name: f.dataType for f in STORED_BILLS.fields if f.name not in (*BILLS.fieldNames(), "id")}
    typed = typed_bills(df.withColumns({f"_{n}": F.col(n) if n in df.columns else F.lit(None) for n in kept}), *[f"_{n}" for n in kept])
    typed = typed.withColumns({n: F.col(f"_{n}").try_cast(t) for n, t in kept.items()})
    typed = typed.withColumns({"id": F.lit(None).cast("long"), "created_at": F.coalesce("created_at", F.current_timestamp())})
    return typed.select(*STORED_BILLS.fieldNames())


def append_bills(df: DataFrame, target: str, first_id: int = 0) -> None:
    """Append to a plain folder of bills, numbering the new ones from ``first_id``.

    Ids are unique, not consecutive: each task counts in a range of its own. Two appends at once need two ranges; a bill table of
    snapshots (``plans.incremental``) hands them out itself.
    """
    numbered = stored_bills(df).withColumn("id", F.lit(first_id) + F.monotonically_increasing_id())
    numbered.write.mode("append").parquet(target)


def next_id(spark: SparkSession, target: str) -> int:
    """First free id of a plain folder of bills; 0 if it has no rows."""
    top = spark.read.parquet(target).agg(F.max("id")).first()[0]
    return 0 if top is None else top + 1
