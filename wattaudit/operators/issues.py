"""Validation results and the bills they concern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns of a bill with an issue, in order; those a bill table lacks are null.
BILL_COLUMNS = (
    "bill_account",
    "customer",
    "bill_date",
    "read_date",
    "days_used",
    "billed_kwh",
    "billed_demand",
    "load_factor",
    "billed_rkva",
    "bill_amount",
    "sales_tax_amt",
    "bill_amount_with_sales_tax",
    "retracted_amt",
    "sales_tax_factor",
)


def validation_results(
    results: DataFrame,
    account: str | None = None,
    bill_id: int | None = None,
    status: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Validation results, newest first, optionally of one account, bill or status, and only the first ``limit``."""
    for column, value in (("account_id", account), ("user_bill_id", bill_id), ("status", status)):
        if value is not None:
            results = results.where(F.col(column) == value)
    ordered = results.orderBy(F.desc("detected_on"), "id")
    return ordered if limit is None else ordered.limit(limit)


def bills_with_issues(
    bills: DataFrame, issues: DataFrame, account: str | None = None, issue_type: str | None = None
) -> DataFrame:
    """Bills joined with their issues: one row per issue, 22 columns."""
    if account is not None:
        bills = bills.where(F.col("bill_account") == account.strip())
    if issue_type is not None:
        issues = issues.where(F.col("issue_type") == issue_type)
    found = issues.select(
        F.col("id").alias("issue_id"), "user_bill_id", "issue_type", "description", "status", "detected_on"
    )
    joined = bills.join(found, bills["id"] == found["user_bill_id"])
    created = F.col("created_at") if "created_at" in bills.columns else F.lit(None).cast("timestamp")
    # ``*_amt`` columns of the text format are optional in a bill table.
    amounts = [F.col(c) if c in bills.columns else F.lit(None).cast("double").alias(c) for c in BILL_COLUMNS]
    return joined.select(
        bills["id"].alias("bill_id"),
        F.col("user_bill_id").alias("fk_user_bill_id"),
        "issue_id",
        *amounts,
        created.alias("bill_created_at"),
        "issue_type",
        "description",
        "status",
        "detected_on",
    )


def flag_issues(bills: DataFrame, issues: DataFrame) -> DataFrame:
    """Every bill with ``_has_issue`` 1 or 0."""
    marked = issues.select(F.col("user_bill_id").alias("id")).where(F.col("id").isNotNull()).distinct()
    marked = marked.withColumn("_has_issue", F.lit(1))
    return bills.join(marked, "id", "left").withColumn("_has_issue", F.coalesce("_has_issue", F.lit(0)))


def issues_of_bill(issues: DataFrame, bill_id: int) -> DataFrame:
    return issues.where(F.col("user_bill_id") == bill_id)
