"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "money": T.DecimalType(18, 2),
    "rate": T.DecimalType(18, 6),
    "texts": T.MapType(T.StringType(), T.StringType()),
}


def table(columns: str) -> T.StructType:
    """Schema of ``name type, …``; needs no running session."""
    pairs = (c.split() for c in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


BILLS = table(
    """
    bill_account string, customer string, bill_date date, read_date date, days_used int, billed_kwh double,
    billed_demand double, load_factor double, billed_rkva double, bill_amount money,
    sales_tax_amt money, bill_amount_with_sales_tax money, retracted_amt money,
    sales_tax_factor double
    """
)
STORED_BILLS = table(
    """
    id bigint, raw_bill_document_id bigint, bill_account string, customer string, bill_date date, read_date date,
    days_used int, billed_kwh double, billed_demand double, load_factor double, billed_rkva double,
    bill_amount money, sales_tax_amt money, bill_amount_with_sales_tax money,
    retracted_amt money, sales_tax_factor double, service_class string, delivery_voltage_kv double,
    created_at timestamp
    """
)
ADJUSTMENT_RATES = table(
    "rate_type string, id bigint, effective_date date, sc_code string, rate rate"
)
VALIDATION_RESULTS = table(
    """
    id bigint, account_id string, user_bill_id bigint, issue_type string, description string, detected_on timestamp,
    status string
    """
)
RAW_DOCUMENTS = table(
    "id bigint, file_name string, file_type string, upload_date timestamp, source string, status string"
)
TARIFF_DOCUMENTS = table(
    """
    id bigint, filename string, utility_name string, upload_date timestamp, document_version string, description string
    """
)
TARIFF_VERSIONS = table("document_id bigint, sc_code string, effective_date date, logic string")
RUNS = table(
    """
    run_id bigint, dag_id string, start_time timestamp, end_time timestamp, status string, total_runtime int,
    error_msg string
    """
)
LOGS = table(
    """
    source string, event_time timestamp, level string, logger_name string, description string, message string,
    log_file string, line_no bigint, context texts
    """
)
