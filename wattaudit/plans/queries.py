"""Every operator as a query over the given tables.

Results are shown in plain types (``plain``): money as double, dates and times as text, lists as one text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattaudit.functions import privacy, text, values
from wattaudit.functions.conditions import with_condition
from wattaudit.functions.tiers import tier_rate
from wattaudit.operators import anomalies as rules
from wattaudit.operators import audits, billtext, columns, documents, issues, pricing, rates, savings, sections
from wattaudit.operators import tiers, upserts, usage, versions
from wattaudit.plans import incremental
from wattaudit.plans.intake import model_inputs
from wattaudit.schemas import BILLS, LOGS, table
from wattaudit.session import work_dir
from wattaudit.sources import bills as bill_source
from wattaudit.sources import files, logs, reports, tariffs, views
from wattaudit.sources.snapshots import SnapshotTable
from wattaudit.streaming.logs import log_windows, read_log_stream, start_log_windows, stream_logs, window_table
from wattaudit.streaming.tables import start_update_table
from wattaudit.streaming.usage import stream_operations, stream_usage

KEY = "bill audit token key"
ACCOUNT = "1120000100"
GENERATED = "2025-01-01 00:00:00 UTC"
ALIASES = {"SC2ND": "SC2"}

# Conditions evaluated for every bill by c5.
CONDITIONS = (
    "Always",
    "user.billed_kwh > 800",
    "user.billed_kwh > 800 and user.billed_demand <= 40",
    "user.bill_date.month in [6,7,8]",
    "not user.days_used < 30 or user.billed_rkva >= 4",
    "delivery_voltage <= 15 kV",
    "2.2 < delivery_voltage < 60",
    "max(user.billed_kwh, 500) / user.days_used >= 40",
    "abs(user.billed_demand - 25) < 10",
    "round(user.billed_kwh / 3, 0) % 2 == 1",
    "user.billed_kwh / user.billed_demand > 30",
    "Applies when demand exceeds 500 kW",
    "__import__('os').getcwd()",
)


def plain(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        out.append(c.alias(f.name))
    return df.select(*out)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(f(spark, sf_dir))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    QUERIES[f.__name__] = run
    return run


def bills(spark: SparkSession, d: str) -> DataFrame:
    return views.bills(spark, d)


def priced_versions(spark: SparkSession) -> DataFrame:
    return tariffs.tariff_versions(views.tariff_json(spark, views.PRICING_TARIFFS))


def rate_table(spark: SparkSession, d: str) -> DataFrame:
    return views.view(spark, d, "adjustment_rates")


def answers(spark: SparkSession, d: str) -> DataFrame:
    return views.view(spark, d, "tariff_answers")


def part_versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions in the tariff documents derived from the part table."""
    good, _ = tariffs.parse_model_json(answers(spark, d))
    return good.select(
        "doc_id",
        "pos",
        F.try_variant_get("item", "$.sc_code", "string").alias("sc_code"),
        values.norm_sc(F.try_variant_get("item", "$.sc_code", "string")).alias("norm_code"),
        tariffs.item_date(F.col("item")).alias("effective_date"),
        F.try_variant_get("item", "$.logic_steps[0].value", "decimal(18,6)").alias("fee"),
        versions.stored_logic(F.col("item")).alias("logic"),
    )


def found_issues(spark: SparkSession, d: str) -> DataFrame:
    b = bills(spark, d)
    # A finding is dated by the bill it concerns.
    return rules.validation_rows(rules.detect_anomalies(b, dated=True), F.col("period_end"))


def priced(spark: SparkSession, d: str, **options: bool) -> DataFrame:
    return pricing.expected_bill(bills(spark, d), priced_versions(spark), rate_table(spark, d), ALIASES, **options)


def audited(spark: SparkSession, d: str, trace: bool = False) -> DataFrame:
    return audits.audit(bills(spark, d), priced_versions(spark), trace=trace)


# ---- scans, sources, sinks


@query
def a1_bills(spark: SparkSession, d: str) -> DataFrame:
    return bill_source.of_account(bills(spark, d), None)


@query
def a2_tariff_versions(spark: SparkSession, d: str) -> DataFrame:
    found = tariffs.tariff_versions(answers(spark, d), body="answer")
    return found.select(
        "doc_id", "pos", "sc_code", "norm_code", "effective_date", F.size("steps").alias("n_steps"),
        F.get("steps", F.lit(0))["number"].alias("fee"),
    )


@query
def a3_doc_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as JSON in both layouts and read back."""
    pages = views.view(spark, d, "tariff_pages")
    cells = F.array(F.concat(F.lit("row "), F.col("page_number").cast("string")), F.col("doc_id").cast("string"))
    pages = pages.withColumn("tables", F.when(F.col("page_number") % 3 != 0, F.array(F.array(cells))))
    listed = F.to_json(F.struct(F.array(F.struct("page_number", "text", "tables")).alias("pages")))
    keyed = F.to_json(F.create_map(F.col("page_number").cast("string"), F.struct("text", "tables")))
    docs = pages.select(
        F.concat_ws("-", "doc_id", "page_number").alias("doc_id"),
        F.when(F.col("page_number") % 2 == 0, listed).otherwise(keyed).alias("body"),
    )
    return tariffs.doc_pages(docs).withColumn("tables", F.to_json("tables"))


@query
def a4_csv_bills(spark: SparkSession, d: str) -> DataFrame:
    """Bills written as CSV and read back with their schema."""
    path = work_dir(spark, "bills-csv")
    files.write_csv(bills(spark, d).select(*_stored()), path)
    return files.read_csv(spark, path, _stored_schema())


@query
def a5_json_bills(spark: SparkSession, d: str) -> DataFrame:
    path = work_dir(spark, "bills-json")
    files.write_json(bills(spark, d).select(*_stored()), path)
    return files.read_json(spark, path, _stored_schema())


def _stored() -> list[str]:
    return ["id", *[c for c in BILLS.fieldNames() if c not in _ABSENT]]


_ABSENT = ("bill_amount_with_sales_tax", "retracted_amt", "sales_tax_factor")


def _stored_schema() -> T.StructType:
    return T.StructType([T.StructField("id", T.LongType()), *[f for f in BILLS.fields if f.name not in _ABSENT]])


@query
def a6_parse_logs(spark: SparkSession, d: str) -> DataFrame:
    """Whole log files."""
    parsed = logs.parse_logs(views.view(spark, d, "log_lines"), "app")
    return parsed.select(*[c for c in LOGS.fieldNames() if c != "context"], F.col("context")["line_number"].alias("noted"))


def _log_files(spark: SparkSession, d: str) -> str:
    """The log lines as text files, a folder per log; the folder of all."""
    path = work_dir(spark, "log-files")
    lines = views.view(spark, d, "log_lines").repartition("file").sortWithinPartitions("file", "line_no")
    lines.select("line", "file").write.partitionBy("file").text(path)
    return path


@query
def a6_log_files(spark: SparkSession, d: str) -> DataFrame:
    """The same lines, read from text files and numbered there."""
    parsed = logs.parse_logs(logs.read_log_lines(spark, f"{_log_files(spark, d)}/*"), "app")
    parsed = parsed.withColumn("log_file", F.regexp_extract("log_file", r"/file=([^/]+)/", 1))
    return parsed.select(*[c for c in LOGS.fieldNames() if c != "context"], F.col("context")["line_number"].alias("noted"))


def _as_text(b: DataFrame) -> DataFrame:
    """Bills as text, some without class."""
    return b.select(
        (F.col("id") % 1000).alias("raw_bill_document_id"),
        F.when(F.col("id") % 7 > 0, F.col("service_class")).alias("service_class"),
        F.col("delivery_voltage_kv").cast("string").alias("delivery_voltage"),
        F.col("read_date").cast("timestamp").alias("created_at"),
        F.col("billed_rkva").cast("string").alias("billed_rkva"),
        "bill_account",
        "customer",
        F.date_format("bill_date", "M/d/yyyy").alias("bill_date"),
        F.date_format("read_date", "M/d/yy").alias("read_date"),
        *[F.col(c).cast("string").alias(c) for c in ("days_used", "billed_kwh", "billed_demand", "load_factor")],
        values.money_text("bill_amount").alias("bill_amount"),
        values.money_text("sales_tax_amt").alias("sales_tax_amt"),
    )


@query
def a7_append_bills(spark: SparkSession, d: str) -> DataFrame:
    """Bills as text, appended to a stored table twice over and read back without the assigned ids."""
    path, as_text = work_dir(spark, "bills-table"), _as_text(bills(spark, d))
    bill_source.append_bills(as_text, path)
    bill_source.append_bills(as_text, path, bill_source.next_id(spark, path))
    return bill_source.read_bills(spark, path).drop("id")


@query
def a1_account_bills(spark: SparkSession, d: str) -> DataFrame:
    return bill_source.of_account(bills(spark, d), f" {ACCOUNT} ")


@query
def e4_stored_audit(spark: SparkSession, d: str) -> DataFrame:
    """Stored bills, priced; those without class by the default class."""
    path = work_dir(spark, "bills-table")
    bill_source.append_bills(_as_text(bills(spark, d)), path)
    return audits.audit(bill_source.read_bills(spark, path), priced_versions(spark)).drop("id")


@query
def e4_account_audit(spark: SparkSession, d: str) -> DataFrame:
    return audits.audit(bills(spark, d), priced_versions(spark), account=ACCOUNT)


@query
def c1_account_results(spark: SparkSession, d: str) -> DataFrame:
    return issues.validation_results(found_issues(spark, d), account=ACCOUNT)


@query
def c1_bill_results(spark: SparkSession, d: str) -> DataFrame:
    """The findings about the bill with the smallest id."""
    return issues.validation_results(found_issues(spark, d), bill_id=bills(spark, d).agg(F.min("id")).first()[0])


@query
def d8_issues_of_bills(spark: SparkSession, d: str) -> DataFrame:
    """The issues of the bill with the smallest id."""
    first = bills(spark, d).agg(F.min("id")).first()[0]
    return issues.issues_of_bill(found_issues(spark, d), first)


@query
def a8_list_documents(spark: SparkSession, d: str) -> DataFrame:
    """Stored tables with the number of their rows; a table of several files counts as one."""
    name = F.regexp_extract("path", r"/(\w+\.parquet)(?:/[^/]*)?$", 1)
    listed = files.list_documents(spark, f"{d}/*.parquet").select(name.alias("file_name")).where("file_name <> ''").distinct()
    counted = None
    for t in views.TABLES:
        rows = views.table(spark, d, t).agg(F.lit(f"{t}.parquet").alias("file_name"), F.count(F.lit(1)).alias("n_rows"))
        counted = rows if counted is None else counted.unionByName(rows)
    return listed.join(counted, "file_name")


@query
def a9_export_results(spark: SparkSession, d: str) -> DataFrame:
    """Priced bills under their display titles, written and read back as CSV."""
    path = work_dir(spark, "export")
    result = files.export_results(priced(spark, d, detail=True).withColumnRenamed("sc_code", "service_class"))
    files.write_csv(result, path)
    return files.read_csv(spark, path, result.schema)


@query
def a9_export_bills(spark: SparkSession, d: str) -> DataFrame:
    """Bills under their display titles."""
    path = work_dir(spark, "export")
    result = files.export_results(bills(spark, d), files.BILL_TITLES)
    files.write_csv(result, path)
    return files.read_csv(spark, path, result.schema)


@query
def a9_export_issues(spark: SparkSession, d: str) -> DataFrame:
    """Findings with the customers of their bills, under their display titles."""
    path = work_dir(spark, "export")
    named = issues.bills_with_issues(bills(spark, d), found_issues(spark, d))
    result = files.export_results(named, files.ISSUE_TITLES)
    files.write_csv(result, path)
    return files.read_csv(spark, path, result.schema)


# ---- projections and cleaning


def _messy(spark: SparkSession, d: str) -> DataFrame:
    return bills(spark, d).select(
        "id",
        F.col("read_date").alias(" Read  Date"),
        F.col("billed_kwh").alias("KWH"),
        F.col("billed_demand").alias("kW Demand"),
        F.col("bill_amount").alias("Amount Due ($)"),
        F.col("service_class").alias("Rate-Class"),
    )


@query
def b1_clean_columns(spark: SparkSession, d: str) -> DataFrame:
    return text.clean_columns(_messy(spark, d))


@query
def b1_strip_columns(spark: SparkSession, d: str) -> DataFrame:
    return text.clean_columns(bills(spark, d).select("id", F.col("bill_amount").alias("  Bill Amount ")), "strip")


@query
def b2_resolve_columns(spark: SparkSession, d: str) -> DataFrame:
    named = bills(spark, d).select(
        "id", F.col("bill_date").alias("Bill Date"), F.col("read_date").alias("Read Date"),
        F.col("billed_kwh").alias("Usage kWh"), F.col("billed_demand").alias("KW Demand"),
        F.col("bill_amount").alias("Total Bill"), F.col("service_class").alias("Rate Class"),
    )
    return columns.as_bill_grid(named, keep=("id",))


@query
def b3_conform(spark: SparkSession, d: str) -> DataFrame:
    target = table(
        "id bigint, bill_date date, service_class string, billed_kwh double, billed_demand double, retracted_amt double"
    )
    exported = bills(spark, d).select(
        "id", F.col("read_date").cast("string").alias("bill_date"), F.col("billed_kwh").cast("string").alias("kwh"),
        F.col("billed_demand").alias("demand_kw"), "customer",
    )
    return columns.conform(
        exported, target, savings.EXPORT_RENAMES, {"service_class": "SC1"}, ("bill_date", "billed_kwh")
    )


@query
def b4_clean_number(spark: SparkSession, d: str) -> DataFrame:
    shown = F.when(F.col("id") % 13 == 0, "-").when(F.col("id") % 17 == 0, "").otherwise(values.money_text("bill_amount"))
    return bills(spark, d).select(
        "id", values.clean_number(shown).alias("ingested"), values.clean_number(shown, "zero").alias("audited"),
        values.clean_int(F.format_number("billed_kwh", 1)).alias("whole"),
    )


@query
def b5_parse_date(spark: SparkSession, d: str) -> DataFrame:
    formats = ["M/d/yyyy", "MM/dd/yy", "yyyy-MM-dd", "yyyy/MM/dd"]
    shown = F.lit("not a date")
    for i, f in enumerate(formats):
        shown = F.when(F.col("id") % 5 == i, F.date_format("read_date", f)).otherwise(shown)
    return bills(spark, d).select("id", values.parse_date(shown).alias("read_date"))


@query
def b6_norm_sc(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lower("service_class"), F.when(F.col("id") % 2 == 0, " ").otherwise(""))
    return bills(spark, d).select(
        "id", values.norm_sc(raw).alias("code"), values.norm_sc(F.when(F.col("id") % 3 == 0, raw)).alias("code_or_blank"),
        values.class_of_label("service_class").alias("code_of_label"),
    )


@query
def b7_month_start(spark: SparkSession, d: str) -> DataFrame:
    return rate_table(spark, d).select("rate_type", "id", values.month_start("effective_date").alias("month"))


@query
def b8_municipality(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("id") % 7 == 0, "Lake Electricity").when(F.col("id") % 11 == 0, F.lit(None)).otherwise(
        F.lower("customer")
    )
    return bills(spark, d).select("id", values.is_municipality(name).alias("is_municipality"))


@query
def b9_tokenize(spark: SparkSession, d: str) -> DataFrame:
    return bills(spark, d).select(
        "id", privacy.tokenize(F.concat(F.lit(" "), "bill_account"), "ACCT", KEY).alias("account_token"),
        privacy.tokenize(F.when(F.col("id") % 4 != 0, F.col("customer")), "NAME", KEY).alias("name_token"),
    )


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    b = bills(spark, d).withColumns(
        {
            "zip": F.when(F.col("id") % 2 == 0, F.lit("12207")).otherwise(""),
            "meter": F.when(F.col("id") % 3 == 0, F.concat(F.lit("M"), "bill_account")),
        }
    )
    charge = F.array(
        F.struct(
            F.lit("Energy").alias("description"), F.col("bill_amount").cast("double").alias("amount"),
            F.lit(None).cast("string").alias("rate_code"),
        )
    )
    return privacy.safe_payload(b, KEY, charges=charge, zip_code="zip", meter="meter")


@query
def b10_safe_payload(spark: SparkSession, d: str) -> DataFrame:
    return _payloads(spark, d)


@query
def b11_no_pii(spark: SparkSession, d: str) -> DataFrame:
    return privacy.assert_no_pii(_payloads(spark, d)).select("id", F.length("payload").alias("n_chars"))


@query
def b11_leaked_fields(spark: SparkSession, d: str) -> DataFrame:
    raw = F.to_json(F.struct("id", F.when(F.col("id") % 2 == 0, F.col("customer")).alias("customer_name"),
                             F.col("bill_account").alias("account_number")))
    return privacy.leaked_fields(bills(spark, d).select("id", raw.alias("payload"))).select("id", "leaked")


@query
def b12_qc_facts(spark: SparkSession, d: str) -> DataFrame:
    return rules.qc_facts(bills(spark, d), KEY)


@query
def b13_usage_cost(spark: SparkSession, d: str) -> DataFrame:
    return usage.usage_cost(views.view(spark, d, "usage_calls")).select("event_id", "cost")


def _holey(spark: SparkSession, d: str) -> DataFrame:
    odd = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 0, F.lit(float("inf")))
    return views.table(spark, d, "events").select("event_id", odd.otherwise(F.col("value")).alias("value"))


@query
def b14_nulls_only(spark: SparkSession, d: str) -> DataFrame:
    return columns.nulls_only(_holey(spark, d))


@query
def b14_bad_values(spark: SparkSession, d: str) -> DataFrame:
    return columns.bad_values(_holey(spark, d), ["event_id"], 20).select("event_id", "bad_columns")


@query
def b15_doc_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    docs = views.bill_documents(bills(spark, d))
    return documents.doc_diagnostics(billtext.with_clean_text(docs))


# ---- filters


@query
def c1_validation_results(spark: SparkSession, d: str) -> DataFrame:
    return issues.validation_results(found_issues(spark, d), status="new", limit=100)


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return rates.override_grid(bills(spark, d), rate_table(spark, d))


@query
def c2_entered_rates(spark: SparkSession, d: str) -> DataFrame:
    kept, _ = rates.entered_rates(rates.grid_rates(_grid(spark, d)))
    return kept


@query
def c2_rejected_rates(spark: SparkSession, d: str) -> DataFrame:
    _, rejected = rates.entered_rates(rates.grid_rates(_grid(spark, d)))
    return rejected.groupBy("rate_type", "sc_code").agg(F.count(F.lit(1)).alias("n_rejected"))


def _registered(spark: SparkSession, d: str) -> DataFrame:
    """File names of the labelled documents."""
    docs = views.view(spark, d, "raw_documents")
    labelled = views.table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return docs.join(labelled, "id", "left_semi").select("file_name")


@query
def c3_new_documents(spark: SparkSession, d: str) -> DataFrame:
    return documents.new_documents(views.view(spark, d, "raw_documents"), _registered(spark, d))


@query
def c4_drop_undated(spark: SparkSession, d: str) -> DataFrame:
    shown = F.when(F.col("id") % 9 == 0, "n/a").otherwise(F.date_format("read_date", "yyyy-MM-dd"))
    return rates.drop_undated(bills(spark, d).select("id", shown.alias("bill_date")))


@query
def c5_conditions(spark: SparkSession, d: str) -> DataFrame:
    """How many bills meet each condition."""
    numbered = F.posexplode(F.array(*[F.lit(c) for c in CONDITIONS])).alias("no", "condition")
    steps = bills(spark, d).select(
        "billed_kwh", "billed_demand", "billed_rkva", "days_used", F.col("read_date").alias("bill_date"),
        F.col("delivery_voltage_kv").alias("delivery_voltage"), numbered,
    )
    held = with_condition(steps)
    return held.groupBy("no").agg(F.count_if("holds").alias("n_held"), F.count(F.lit(1)).alias("n_bills"))


@query
def c6_code_mismatch(spark: SparkSession, d: str) -> DataFrame:
    found = part_versions(spark, d).withColumn("section_code", F.concat(F.lit("SC"), (F.col("doc_id") % 20).cast("string")))
    return versions.code_mismatch(found).select("doc_id", "pos", "section_code", "sc_code")


# ---- joins


@query
def d1_bills_with_issues(spark: SparkSession, d: str) -> DataFrame:
    return issues.bills_with_issues(bills(spark, d), found_issues(spark, d))


@query
def d1_account_issues(spark: SparkSession, d: str) -> DataFrame:
    """Bills of one account with their findings of one type."""
    return issues.bills_with_issues(bills(spark, d), found_issues(spark, d), f" {ACCOUNT} ", rules.R2_DAYS)


@query
def d2_pick_version(spark: SparkSession, d: str) -> DataFrame:
    picked = versions.pick_version(bills(spark, d), priced_versions(spark), True)
    return picked.select("id", "norm_code", F.col("version.effective_date").alias("effective_date"))


@query
def d3_pick_version_strict(spark: SparkSession, d: str) -> DataFrame:
    picked = versions.pick_version(bills(spark, d), priced_versions(spark), False)
    return picked.select("id", "norm_code", F.col("version.effective_date").alias("effective_date"))


@query
def d2_carried_version(spark: SparkSession, d: str) -> DataFrame:
    """The way for more versions than are broadcast."""
    picked = versions.pick_version(bills(spark, d), priced_versions(spark), True, max_rows=0)
    return picked.select("id", "norm_code", F.col("version.effective_date").alias("effective_date"))


@query
def d3_carried_version_strict(spark: SparkSession, d: str) -> DataFrame:
    picked = versions.pick_version(bills(spark, d), priced_versions(spark), False, max_rows=0)
    return picked.select("id", "norm_code", F.col("version.effective_date").alias("effective_date"))


@query
def d4_rates_for_bills(spark: SparkSession, d: str) -> DataFrame:
    b = bills(spark, d).withColumn("sc_code", values.norm_sc("service_class"))
    joined = rates.rates_for_bills(b, rate_table(spark, d), date=F.col("read_date"))
    return joined.select("id", *[f"override_{t}" for t in rates.RATE_TYPES])


@query
def d4_override_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d)


@query
def d4_class_grid(spark: SparkSession, d: str) -> DataFrame:
    return rates.override_grid(bills(spark, d), rate_table(spark, d), "sc-1 c")


@query
def d5_tier_rate(spark: SparkSession, d: str) -> DataFrame:
    """The tiered demand charge of class SC3 for the voltage of every bill."""
    steps = priced_versions(spark).where(F.col("norm_code") == "SC3").select(F.get("steps", F.lit(1)).alias("step"))
    step = steps.scalar()
    return bills(spark, d).select("id", "delivery_voltage_kv", step.alias("step")).select(
        "id", tier_rate(F.col("step.number"), F.col("step.tiers"), F.col("delivery_voltage_kv")).alias("rate")
    )


@query
def d5_step_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rate of every step of every bill's own version, for its voltage."""
    found = priced_versions(spark)
    picked = versions.pick_version(bills(spark, d), found)
    return tiers.step_rates(picked, found).select("id", "norm_code", "step_no", "step_name", "rate")


def _compared(spark: SparkSession, d: str) -> DataFrame:
    """Every bill under its own class and under another: SC1C for bills of SC1, SC1 for the rest."""
    b, v = bills(spark, d), priced_versions(spark)
    other = F.when(values.norm_sc("service_class") == "SC1", "SC-1C").otherwise("SC-1")
    old = pricing.expected_bill(b, v, detail=True)
    new = pricing.expected_bill(b.withColumn("service_class", other), v, detail=True)
    return savings.savings(old, new)


@query
def d6_savings(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d)


@query
def d7_attach_tables(spark: SparkSession, d: str) -> DataFrame:
    pages = views.view(spark, d, "tariff_pages")
    headed = pages.select("doc_id", "page_number", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    # Every headline of a page stands for a table on it.
    tables = headed.where(F.col("line").startswith("SERVICE") | F.col("line").startswith("Effective")).select(
        "doc_id", "page_number", F.col("line").alias("table")
    )
    return sections.attach_tables(pages, tables).select("doc_id", "page_number", F.length("text").alias("n_chars"), "table")


@query
def d8_flag_issues(spark: SparkSession, d: str) -> DataFrame:
    return issues.flag_issues(bills(spark, d), found_issues(spark, d)).select("id", "_has_issue")


@query
def d9_orphan_files(spark: SparkSession, d: str) -> DataFrame:
    stored = views.view(spark, d, "raw_documents").select("file_name").distinct()
    return documents.orphan_files(stored, _registered(spark, d))


@query
def d10_token_map(spark: SparkSession, d: str) -> DataFrame:
    known = views.table(spark, d, "customer").where(F.col("c_acctbal") < 0)
    account = (F.col("c_custkey") + 1120000000).cast("string")
    existing = known.select(privacy.tokenize(account, "ACCT", KEY).alias("token"), F.concat(F.lit("known "), account).alias("account_number"))
    return documents.token_map(bills(spark, d), existing, KEY)


@query
def d11_sc_codes(spark: SparkSession, d: str) -> DataFrame:
    return versions.sc_codes(part_versions(spark, d))


@query
def d11_all_versions(spark: SparkSession, d: str) -> DataFrame:
    return versions.all_versions(part_versions(spark, d)).select("doc_id", "pos", "sc_code", "effective_date", "logic")


@query
def d11_versions_of_class(spark: SparkSession, d: str) -> DataFrame:
    return versions.versions_of(part_versions(spark, d), "SC7")


@query
def d11_logic_of(spark: SparkSession, d: str) -> DataFrame:
    return versions.logic_of(part_versions(spark, d), "SC7", "1997-06-01").select("doc_id", "pos", "fee")


# ---- aggregates


@query
def e1_expected_bill(spark: SparkSession, d: str) -> DataFrame:
    return priced(spark, d)


@query
def e2_trace(spark: SparkSession, d: str) -> DataFrame:
    return priced(spark, d, trace=True).select("id", "trace")


@query
def e3_expected_bill_legacy(spark: SparkSession, d: str) -> DataFrame:
    legacy = tariffs.tariff_versions(views.tariff_json(spark, views.LEGACY_TARIFFS))
    return pricing.expected_bill_legacy(bills(spark, d), legacy)


@query
def e4_audit(spark: SparkSession, d: str) -> DataFrame:
    return audited(spark, d)


@query
def e5_audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return audits.audit_summary(audited(spark, d), by_account=True)


@query
def e6_report_totals(spark: SparkSession, d: str) -> DataFrame:
    return audits.report_totals(priced(spark, d))


@query
def e7_savings_totals(spark: SparkSession, d: str) -> DataFrame:
    return savings.savings_totals(_compared(spark, d))


@query
def e8_accounts(spark: SparkSession, d: str) -> DataFrame:
    return documents.accounts(bills(spark, d))


@query
def e9_anomaly_summary(spark: SparkSession, d: str) -> DataFrame:
    b = bills(spark, d)
    return rules.anomaly_summary(b, rules.detect_anomalies(b))


@query
def e10_model_usage(spark: SparkSession, d: str) -> DataFrame:
    return usage.llm_usage(views.view(spark, d, "usage_calls"))


@query
def e11_operation_usage(spark: SparkSession, d: str) -> DataFrame:
    return usage.op_usage(views.view(spark, d, "usage_calls"))


@query
def e12_override_counts(spark: SparkSession, d: str) -> DataFrame:
    return rates.override_counts(_grid(spark, d))


def _bill_docs(spark: SparkSession, d: str) -> DataFrame:
    return views.bill_documents(bills(spark, d))


@query
def e13_canonical_customer(spark: SparkSession, d: str) -> DataFrame:
    docs = _bill_docs(spark, d)
    return billtext.canonical_customer(billtext.with_clean_text(docs))


@query
def e13_account_customers(spark: SparkSession, d: str) -> DataFrame:
    """One name per account, where headers are misspelt, shorter, unrelated or missing."""
    docs = views.named_documents(bills(spark, d))
    return billtext.account_customers(billtext.with_clean_text(docs))


@query
def e14_report_lines(spark: SparkSession, d: str) -> DataFrame:
    return audits.report_lines(audited(spark, d, trace=True), GENERATED)


@query
def e14_report_file(spark: SparkSession, d: str) -> DataFrame:
    """All reports written as files, and that of one account read back."""
    folder = work_dir(spark, "reports")
    reports.write_reports(audits.report_lines(audited(spark, d, trace=True), GENERATED), folder, 1 << 20)
    found = reports.read_report(spark, folder, ACCOUNT)
    return found.select("line")


# ---- windows and rules


@query
def f1_r1_spikes(spark: SparkSession, d: str) -> DataFrame:
    return rules.r1_spikes(bills(spark, d))


@query
def f2_r4_tax(spark: SparkSession, d: str) -> DataFrame:
    return rules.r4_tax(bills(spark, d))


@query
def f3_r5_swing(spark: SparkSession, d: str) -> DataFrame:
    return rules.r5_swing(bills(spark, d))


@query
def f4_r6_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return rules.r6_duplicates(bills(spark, d))


@query
def f5_latest_month_rate(spark: SparkSession, d: str) -> DataFrame:
    return rates.latest_month_rate(rate_table(spark, d))


@query
def f6_version_intervals(spark: SparkSession, d: str) -> DataFrame:
    found = versions.version_intervals(part_versions(spark, d))
    return found.select("norm_code", "effective_date", "doc_id", "valid_from", "valid_to", "is_last")


@query
def f7_section_pages(spark: SparkSession, d: str) -> DataFrame:
    placed = sections.section_pages(views.view(spark, d, "tariff_pages"))
    return placed.withColumn("text", F.md5("text"))


@query
def f8_recent_calls(spark: SparkSession, d: str) -> DataFrame:
    return usage.recent_calls(views.view(spark, d, "usage_calls")).select("kind", "place", "event_id", "key", "success")


@query
def f9_bill_numbers(spark: SparkSession, d: str) -> DataFrame:
    return audits.bill_numbers(audited(spark, d)).select("id", "bill_account", "bill_no")


@query
def g1_r2_days(spark: SparkSession, d: str) -> DataFrame:
    return rules.r2_days(bills(spark, d))


@query
def g2_r3_non_positive(spark: SparkSession, d: str) -> DataFrame:
    return rules.r3_non_positive(bills(spark, d))


@query
def g3_detect_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return rules.detect_anomalies(bills(spark, d))


@query
def g3_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Bills uploaded in three parts in order of their ids, the findings brought up to date after each of them."""
    b, folder = bills(spark, d), work_dir(spark, "audit")
    table_, findings = incremental.bill_table(spark, folder), incremental.finding_table(spark, folder)
    low, high = b.agg(F.min("id"), F.max("id")).first()
    step = 0 if low is None else (high - low) // 3 + 1
    for part in range(3):
        new = b.where(F.col("id").between((low or 0) + part * step, (low or 0) + (part + 1) * step - 1))
        incremental.upload_bills(table_, new.orderBy("id"))
        incremental.validate_new(table_, findings)
    return findings.read().drop("detected_on")


@query
def g3_bill_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Findings nested by bill."""
    return rules.bill_anomalies(rules.detect_anomalies(bills(spark, d)))


# ---- limits, sets and upserts


@query
def h1_recent_runs(spark: SparkSession, d: str) -> DataFrame:
    return documents.recent_runs(documents.run_ledger(views.view(spark, d, "run_events")))


@query
def h3_first_lines(spark: SparkSession, d: str) -> DataFrame:
    """The capped import: the first 5,000 lines of each log file."""
    parsed = logs.parse_logs(views.view(spark, d, "log_lines"), "app", logs.MAX_LINES)
    return parsed.groupBy("log_file").agg(F.count(F.lit(1)).alias("n_lines"), F.max("line_no").alias("last_line"))


@query
def h4_model_texts(spark: SparkSession, d: str) -> DataFrame:
    """What the extraction model is given of each section."""
    placed = sections.section_pages(views.view(spark, d, "tariff_pages"))
    texts = sections.section_text(placed, sections.MODEL_CHARS)
    return texts.select(*sections.SECTION, F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query
def i1_unregistered_names(spark: SparkSession, d: str) -> DataFrame:
    """Set difference of incoming and registered file names."""
    return documents.new_documents(views.view(spark, d, "raw_documents"), _registered(spark, d)).select("file_name")


@query
def j1_parse_model_json(spark: SparkSession, d: str) -> DataFrame:
    return part_versions(spark, d)


@query
def j1_unreadable_answers(spark: SparkSession, d: str) -> DataFrame:
    _, bad = tariffs.parse_model_json(answers(spark, d))
    return bad


def rate_changes(spark: SparkSession, d: str) -> DataFrame:
    """One entry per supplier (some blank)."""
    s, key = views.table(spark, d, "supplier"), F.col("s_suppkey")
    kinds = F.array(*[F.lit(t) for t in rates.RATE_TYPES])
    codes = F.array(*[F.lit(c) for c in ("SC1", "SC1C", "SC2", "SC2D", "SC3", " ")])
    return s.select(
        F.get(kinds, (key % 4).cast("int")).alias("rate_type"),
        F.get(codes, (key % 6).cast("int")).alias("sc_code"),
        F.make_date((1996 + key % 7).cast("int"), (1 + key % 12).cast("int"), (1 + key % 28).cast("int")).alias("effective_date"),
        F.when(key % 11 != 0, (key.cast("decimal(12,0)") * F.lit("0.0001").cast("decimal(4,4)")).cast("decimal(18,6)")).alias("rate"),
        key.alias("seq"),
    )


@query
def k1_upsert_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of the part table, changed by one entry per supplier (blank ones skipped)."""
    return upserts.upsert_rates(rate_table(spark, d), rate_changes(spark, d))


def version_changes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Versions in bare JSON documents as the register, all versions as changes in order of their documents; written once for both."""
    stored = part_versions(spark, d).select(
        F.col("doc_id").alias("document_id"), "sc_code", "effective_date", "logic", "pos", F.col("doc_id").alias("seq")
    )
    path = work_dir(spark, "version-changes")
    stored.where(F.col("pos") == 0).write.parquet(path)
    changes = spark.read.schema(stored.schema).parquet(path)
    register = changes.groupBy("sc_code", "effective_date").agg(
        F.min("document_id").alias("document_id"), F.min_by("logic", "document_id").alias("logic")
    )
    return register.select("document_id", "sc_code", "effective_date", "logic"), changes


@query
def k2_upsert_versions(spark: SparkSession, d: str) -> DataFrame:
    return versions.upsert_versions(*version_changes(spark, d))


def document_changes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every document registered in order of its id; the register holds the last one of each name."""
    docs = views.view(spark, d, "raw_documents")
    incoming = docs.select(
        F.col("file_name").alias("filename"), F.concat(F.lit("Utility "), "source").alias("utility_name"),
        F.col("id").alias("upload_date"), F.col("id").alias("document_version"),
    )
    register = incoming.groupBy("filename").agg(
        F.lit("unknown").alias("utility_name"), F.lit(-1).cast("long").alias("upload_date"),
        F.lit(-1).cast("long").alias("document_version"),
    )
    return register, incoming


@query
def k3_upsert_documents(spark: SparkSession, d: str) -> DataFrame:
    return versions.upsert_documents(*document_changes(spark, d))


def status_changes(spark: SparkSession, d: str) -> DataFrame:
    labels = views.table(spark, d, "labels")
    return labels.select(
        F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "error").otherwise("processed").alias("status")
    )


@query
def k4_update_status(spark: SparkSession, d: str) -> DataFrame:
    return upserts.update_by_key(views.view(spark, d, "raw_documents"), status_changes(spark, d), "id").select("id", "file_name", "status")


@query
def k5_run_ledger(spark: SparkSession, d: str) -> DataFrame:
    return documents.run_ledger(views.view(spark, d, "run_events"))


# ---- the same on stored tables


@query
def k1_stored_rates(spark: SparkSession, d: str) -> DataFrame:
    """The changes of k1 on a stored table; new months get the next free ids (shown as null)."""
    old, changes = rate_table(spark, d), rate_changes(spark, d)
    stored = SnapshotTable(spark, work_dir(spark, "rates"), old.schema, ["rate_type", "sc_code"], 16)
    first = stored.load(old, "id").next_id
    changes = changes.withColumn("sc_code", F.trim("sc_code"))
    stored.rewrite(stored.touched(changes), lambda base: upserts.upsert_rates(base, changes), "id")
    return stored.read().withColumn("id", F.when(F.col("id") < first, F.col("id")))


@query
def k2_stored_versions(spark: SparkSession, d: str) -> DataFrame:
    register, changes = version_changes(spark, d)
    stored = SnapshotTable(spark, work_dir(spark, "versions"), register.schema, ["sc_code", "effective_date"], 16)
    stored.load(register)
    stored.upsert(changes, "seq")
    return stored.read()


@query
def k3_stored_documents(spark: SparkSession, d: str) -> DataFrame:
    register, incoming = document_changes(spark, d)
    stored = SnapshotTable(spark, work_dir(spark, "documents"), register.schema, ["filename"], 16)
    stored.load(register)
    stored.upsert(incoming, "upload_date")
    return stored.read()


@query
def k4_stored_status(spark: SparkSession, d: str) -> DataFrame:
    docs = views.view(spark, d, "raw_documents")
    stored = SnapshotTable(spark, work_dir(spark, "raw-documents"), docs.schema, ["id"], 16)
    stored.load(docs)
    stored.update(status_changes(spark, d))
    return stored.read().select("id", "file_name", "status")


@query
def k5_stored_runs(spark: SparkSession, d: str) -> DataFrame:
    """Run events stored in two parts; after each, the ledger of the touched runs is made anew."""
    events = views.view(spark, d, "run_events")
    ledger = documents.run_ledger(events)
    folder = work_dir(spark, "runs")
    stored = SnapshotTable(spark, f"{folder}/events", events.schema, ["run_id"], 16)
    runs = SnapshotTable(spark, f"{folder}/ledger", ledger.schema, ["run_id"], 16)
    for part in range(2):
        new = events.where(F.pmod(F.xxhash64("run_id", F.col("ts").cast("string")), F.lit(2)) == part)
        touched = stored.touched(new)
        stored.append(new)
        runs.rewrite(touched, lambda _: documents.run_ledger(stored.read(touched)))  # noqa: B023
    return runs.read()


# ---- text


@query
def l1_bill_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = billtext.bill_rows(_bill_docs(spark, d))
    return rows.select(
        "bill_account", "customer", "bill_date", "read_date", "days_used", "billed_kwh", "billed_demand", "load_factor",
        "billed_rkva", "bill_amount", "sales_tax_amt", "bill_amount_with_sales_tax", "retracted_amt", "sales_tax_factor",
    )


@query
def l2_tariff_sections(spark: SparkSession, d: str) -> DataFrame:
    return sections.tariff_sections(views.view(spark, d, "tariff_pages"))


@query
def l2_model_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Page-text documents as JSON → the text of every section that the extraction model is given."""
    page = F.struct("page_number", "text")
    docs = views.view(spark, d, "tariff_pages").groupBy("doc_id").agg(F.to_json(F.struct(F.collect_list(page).alias("pages"))).alias("body"))
    found = model_inputs(docs)
    return found.select("doc_id", "sc_code", "start_page", "end_page", "effective_date", F.md5("text").alias("digest"))


@query
def n1_names(spark: SparkSession, d: str) -> DataFrame:
    docs = views.table(spark, d, "documents")
    return docs.select(
        "doc_id", F.md5(text.norm_caps("text")).alias("caps"), text.sheet_name(F.col("text")).alias("sheet"),
        F.length(text.norm_space("text")).alias("n_chars"),
    )


def _tokens(b: DataFrame) -> DataFrame:
    kinds: list[Column] = [
        F.date_format("read_date", "M/d/yyyy"), F.col("bill_amount").cast("string"), values.money_text("bill_amount"),
        F.format_number("billed_kwh", 0), F.col("load_factor").cast("string"), F.col("bill_account"), F.col("customer"),
        F.concat(F.lit("Page "), F.col("days_used").cast("string"), F.lit(" of 40")),
    ]
    return b.select("id", F.posexplode(F.array(*kinds)).alias("no", "token"))


@query
def n2_token_kinds(spark: SparkSession, d: str) -> DataFrame:
    tested = _tokens(bills(spark, d)).select(
        "id", "no", text.token_kind("token").alias("kind"), text.has_page_footer("token").alias("is_footer")
    )
    return tested.select(
        "id", "no", F.col("kind.date").alias("is_date"), F.col("kind.whole").alias("is_int"), F.col("kind.number").alias("is_num"),
        F.col("kind.money").alias("is_money"), "is_footer",
    )


@query
def n3_number_formats(spark: SparkSession, d: str) -> DataFrame:
    return bills(spark, d).select(
        "id", values.money_text("bill_amount").alias("money"), values.int_text(F.col("billed_kwh").cast("int")).alias("whole"),
        values.trimmed_decimal(F.col("bill_amount").cast("string"), 2).alias("trimmed"),
    )


@query
def n4_repair_scan(spark: SparkSession, d: str) -> DataFrame:
    """Dates printed with scan errors, and glued to one another."""
    day, month = F.dayofmonth("read_date"), F.month("read_date")
    m, dd, y = month.cast("string"), F.date_format("read_date", "dd"), F.date_format("read_date", "yyyy")
    head = F.when(month == 10, "1A0R/").otherwise(F.concat(m, F.when(F.col("id") % 2 == 0, " AB / ").otherwise("/")))
    broken = F.when((day >= 10) & (day < 20) & (month != 10), F.concat(m, F.lit("A/1R"), F.substring(dd, 2, 1), F.lit("/"), y))
    broken = broken.otherwise(F.concat(head, dd, F.lit("/"), y))
    twice = F.concat(broken, F.date_format("read_date", "MM/dd/yyyy"))
    return bills(spark, d).select("id", text.repair_scan(broken).alias("repaired"), text.repair_scan(twice).alias("parted"))


@query
def n6_effective_date(spark: SparkSession, d: str) -> DataFrame:
    pages = views.view(spark, d, "tariff_pages")
    worded = F.concat(F.lit("INITIAL EFFECTIVE DATE: "), F.upper(F.date_format(F.make_date(
        (1990 + F.col("doc_id") % 30).cast("int"), (1 + F.col("page_number") % 12).cast("int"), F.lit(9)), "MMMM")),
        F.lit("  9, "), (1990 + F.col("doc_id") % 30).cast("string"))
    return pages.select(
        "doc_id", "page_number", text.effective_date("text").alias("printed"), text.effective_date(worded).alias("worded")
    )


# ---- streams


def _calls_stream(spark: SparkSession, d: str) -> DataFrame:
    events = views.table(spark, d, "events")
    raw = spark.readStream.schema(events.schema).parquet(f"{d}/event[s].parquet")
    return spark.sql(views.USAGE_CALLS, events=raw)


def _final(spark: SparkSession, stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    folder = work_dir(spark, name)
    stored = SnapshotTable(spark, f"{folder}/table", stream.schema, keys, 16)
    start_update_table(stream, stored, f"{folder}/checkpoint").awaitTermination()
    return stored.read()


@query
def s1_stream_usage(spark: SparkSession, d: str) -> DataFrame:
    return _final(spark, stream_usage(_calls_stream(spark, d)), "usage", ["month", "model"])


@query
def s1_stream_operations(spark: SparkSession, d: str) -> DataFrame:
    return _final(spark, stream_operations(_calls_stream(spark, d)), "operations", ["month", "operation"])


@query
def s2_stream_logs(spark: SparkSession, d: str) -> DataFrame:
    events = views.table(spark, d, "events")
    raw = spark.readStream.schema(events.schema).parquet(f"{d}/event[s].parquet")
    lines = spark.sql(views.LOG_LINES, events=raw)
    return _final(spark, stream_logs(lines, "app"), "logs", ["source", "level", "hour"])


@query
def s2_log_files(spark: SparkSession, d: str) -> DataFrame:
    """Log files as a stream of text in two runs: the whole logs, then every fiftieth line once more, most of them late."""
    folder = work_dir(spark, "log-stream")
    stored = window_table(spark, f"{folder}/windows")
    lines = views.view(spark, d, "log_lines")
    for part in (lines, lines.where(F.col("line_no") % 50 == 0)):
        part.select("line").write.mode("append").text(f"{folder}/lines")
        stream = read_log_stream(spark, f"{folder}/lines")
        start_log_windows(stream, stored, f"{folder}/checkpoint", "app").awaitTermination()
    return log_windows(stored)
