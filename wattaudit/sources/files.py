"""CSV and JSON tables, stored files and exports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column titles of the exported result, bill and issue tables.
RESULT_TITLES = {
    "bill_date": "Bill Date",
    "service_class": "Service Class",
    "kwh": "kWh",
    "demand_kw": "Demand (kW)",
    "actual_bill": "Actual Bill",
    "tra": "TRA",
    "rdm": "RDM",
    "expected_bill": "Expected Bill",
    "variance": "Variance",
    "status": "Status",
}
BILL_TITLES = {
    "id": "Bill ID",
    "bill_account": "Bill Account",
    "customer": "Customer",
    "bill_date": "Bill Date",
    "read_date": "Read Date",
    "days_used": "Days Used",
    "billed_kwh": "Billed kWh",
    "billed_demand": "Billed Demand",
    "load_factor": "Load Factor",
    "billed_rkva": "Billed rKVA",
    "bill_amount": "Bill Amount",
    "sales_tax_amt": "Sales Tax Amount",
    "bill_amount_with_sales_tax": "Bill Amount (With Tax)",
    "retracted_amt": "Retracted Amount",
    "sales_tax_factor": "Sales Tax Factor",
    "created_at": "Uploaded At",
}
ISSUE_TITLES = {
    "bill_id": "Bill ID",
    "fk_user_bill_id": "Bill ID (FK)",
    "issue_id": "Issue ID",
    "issue_type": "Issue Type",
    "description": "Description",
    "status": "Status",
    "detected_on": "Detected On",
    "bill_account": "Bill Account",
    "customer": "Customer",
}


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, multiLine=False, mode="PERMISSIVE")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.csv(path, header=True, mode=mode)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.json(path, schema=schema)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.json(path, mode=mode, ignoreNullFields=False)


def list_documents(spark: SparkSession, path: str) -> DataFrame:
    """Stored files with name, size and time of change; their content is not read."""
    return spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), "path", "modificationTime", "length"
    )


def export_results(df: DataFrame, titles: Mapping[str, str] = RESULT_TITLES) -> DataFrame:
    """The titled columns that are present, under their titles, in title order."""
    return df.select(*[F.col(c).alias(t) for c, t in titles.items() if c in df.columns])
