"""Portfolio audit, its summaries and the text report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattaudit.operators.columns import as_date, as_number
from wattaudit.operators.history import HotKeys, cut, profile
from wattaudit.operators.pricing import expected_bill
from wattaudit.session import work_dir

HIGH_VARIANCE = 0.05


def audit(
    bills: DataFrame,
    versions: DataFrame,
    account: str | None = None,
    default_sc: str = "SC1",
    trace: bool = False,
) -> DataFrame:
    """Price all bills by their bill date, without adjustment rates, after cleaning numbers (bad → 0) and dates."""
    if account is not None:
        bills = bills.where(F.col("bill_account") == account.strip())
    known = F.col("service_class") if "service_class" in bills.columns else F.lit(None)
    bills = bills.withColumn("service_class", F.coalesce(F.nullif(F.trim(known), F.lit("")), F.lit(default_sc)))
    kinds = {
        "billed_kwh": "double",
        "billed_demand": "double",
        "billed_rkva": "double",
        "bill_amount": "decimal(18,2)",
        "days_used": "int",
    }
    cleaned = {c: as_number(bills, c, t, "zero") for c, t in kinds.items() if c in bills.columns}
    bills = bills.withColumns({**cleaned, "bill_date": as_date(bills, "bill_date")})
    return expected_bill(bills, versions, None, bill_date=F.col("bill_date"), trace=trace)


def _summary() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_bills"),
        F.sum("variance").cast("decimal(28,2)").alias("total_variance"),
        F.count_if(F.abs("variance") > F.lit(HIGH_VARIANCE).cast("decimal(3,2)")).alias("high_variance_bills"),
        F.count_if(F.col("status") != "SUCCESS").alias("calculation_errors"),
    ]


def audit_summary(audited: DataFrame, by_account: bool = False) -> DataFrame:
    """Bill count, total variance, bills off by more than $0.05, bills not priced; per account plus a grand total,
    which ``is_total`` tells from bills without account."""
    if not by_account:
        return audited.agg(*_summary())
    return audited.rollup("bill_account").agg(*_summary(), (F.grouping("bill_account") == 1).alias("is_total"))


def report_totals(audited: DataFrame) -> DataFrame:
    """Sums of actual, expected and variance over the rounded rows."""
    return audited.agg(
        *[F.sum(c).cast("decimal(28,2)").alias(n) for c, n in (
            ("actual_bill", "total_actual"), ("expected_bill", "total_expected"), ("variance", "total_variance")
        )]
    )


def bill_numbers(audited: DataFrame, hot: HotKeys = HotKeys()) -> DataFrame:
    """Add ``bill_no``, the 1-based place of a bill in the report of its account (by date, then id)."""
    parts = cut(audited, "bill_account", "bill_date", "id", profile(audited, "bill_account", "id"), 0, 0, hot)
    place = F.row_number().over(W.partitionBy("bill_account", "chunk").orderBy("bill_date", "id"))
    return parts.withColumn("bill_no", F.coalesce(F.col("position") + 1, place.cast("long"))).drop(
        "position", "chunk", "is_halo", "hot_n_rows"
    )


def _amount(name: str) -> Column:
    return F.concat(F.lit("$"), F.coalesce(F.col(name), F.lit(0)).cast("decimal(18,2)").cast("string"))


# Layout of the report.
RULE = "=" * 80
THIN_RULE = "-" * 80


# Fixed values below: the labels of the report.
def report_lines(audited: DataFrame, generated: str, hot: HotKeys = HotKeys()) -> DataFrame:
    """Report of each account as rows (bill_account, bill_no, line_no, line); bill_no 0 is the head, the number
    after the last bill the end.

    ``audited`` needs the ``trace`` column. It is written once, so that bills are priced once for heads, bill numbers and blocks.
    """
    path = work_dir(audited.sparkSession, "audited")
    audited.write.parquet(path)
    audited = audited.sparkSession.read.schema(audited.schema).parquet(path)
    head = F.array(
        F.lit(RULE),
        F.lit("BILL AUDIT REPORT"),
        F.lit(RULE),
        F.concat(F.lit("Account ID: "), F.col("bill_account")),
        F.lit(f"Generated: {generated}"),
        F.concat(F.lit("Total Bills Audited: "), F.col("total_bills").cast("string")),
        F.lit(RULE),
        F.lit(""),
        F.lit("SUMMARY:"),
        F.concat(F.lit("  Total Variance: $"), F.col("total_variance").cast("string")),
        F.concat(F.lit("  High Variance Bills (>5%): "), F.col("high_variance_bills").cast("string")),
        F.concat(F.lit("  Calculation Errors: "), F.col("calculation_errors").cast("string")),
        F.lit(""),
        F.lit(THIN_RULE),
        F.lit(""),
        F.lit("DETAILED RESULTS:"),
        F.lit(""),
    )
    tail = F.array(F.lit(RULE), F.lit("END OF REPORT"), F.lit(RULE))

    def numbered(lines: Column, bill_no: Column) -> Column:
        return F.transform(
            lines, lambda t, i: F.struct(bill_no.alias("bill_no"), i.alias("line_no"), t.alias("line"))
        )

    frame = F.concat(numbered(head, F.lit(0).cast("long")), numbered(tail, F.col("total_bills") + 1))
    frames = audited.groupBy("bill_account").agg(*_summary()).select("bill_account", F.explode(frame).alias("l"))
    frames = frames.select("bill_account", "l.*")
    trace = F.when(
        F.size("trace") > 0,
        F.concat(
            F.array(F.lit("  Calculation Trace:")), F.transform("trace", lambda t: F.concat(F.lit("    - "), t))
        ),
    ).otherwise(F.array().cast("array<string>"))
    block = F.concat(
        F.array(
            F.concat(F.lit("Bill #"), F.col("bill_no").cast("string"), F.lit(":")),
            F.concat(F.lit("  Date: "), F.coalesce(F.date_format("bill_date", "yyyy-MM-dd"), F.lit("N/A"))),
            F.concat(F.lit("  Service Class: "), F.coalesce("sc_code", F.lit("N/A"))),
            F.concat(F.lit("  Account: "), F.coalesce("bill_account", F.lit("N/A"))),
            F.concat(F.lit("  Actual Amount: "), _amount("actual_bill")),
            F.concat(F.lit("  Expected Amount: "), _amount("expected_bill")),
            F.concat(F.lit("  Variance: "), _amount("variance")),
            F.concat(F.lit("  Status: "), F.col("status")),
        ),
        trace,
        F.array(F.lit("")),
    )
    blocks = bill_numbers(audited, hot).select(
        "bill_account", "bill_no", F.posexplode(block).alias("line_no", "line")
    )
    return frames.unionByName(blocks)
