"""Bill, rate, tariff, usage and log tables derived from the given test tables.

Each view is one SELECT over the given tables that Spark and DuckDB both understand, so that the checks run on the same
data. No view has a window or a join on a skewed key: bills join orders with their own line items on the order key.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BILLS = """
WITH li AS (
  SELECT l_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS q, max(l_quantity) AS mx, CAST(count(*) AS INT) AS n,
         CAST(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_tax * 100) AS BIGINT)) AS DECIMAL(18,0))
              * CAST(0.0001 AS DECIMAL(4,4)) AS DECIMAL(18,2)) AS tax
  FROM {lineitem} GROUP BY l_orderkey),
b AS (
  SELECT o.o_orderkey AS id, CAST(1120000000 + o.o_custkey AS STRING) AS bill_account,
         CASE WHEN o.o_custkey % 10 = 0 THEN concat('TOWN OF NO. ', CAST(o.o_custkey AS STRING))
              ELSE concat('CUSTOMER ', CAST(o.o_custkey AS STRING), ' INC.') END AS customer,
         CASE o.o_custkey % 5 WHEN 0 THEN 'SC-1' WHEN 1 THEN 'SC-1C' WHEN 2 THEN 'SC2-ND' WHEN 3 THEN 'SC2-D'
              ELSE 'SC3' END AS service_class,
         CAST(o.o_orderdate AS DATE) + 2 AS bill_date, CAST(o.o_orderdate AS DATE) AS read_date,
         CAST(22 + o.o_orderkey % 17 AS INT) AS days_used,
         CASE WHEN o.o_orderkey % 97 = 0 THEN 0.0E0 ELSE li.q * 10 END AS billed_kwh,
         CASE WHEN o.o_custkey % 3 = 0 THEN 0.0E0 ELSE li.mx END AS billed_demand,
         CASE WHEN o.o_custkey % 3 = 0 THEN 0.0E0
              ELSE round(li.q * 10 / (li.mx * 24 * (22 + o.o_orderkey % 17)), 2) END AS load_factor,
         CAST(li.n AS DOUBLE) AS billed_rkva,
         CASE o.o_orderkey % 4 WHEN 1 THEN 2.2E0 WHEN 2 THEN 13.2E0 WHEN 3 THEN 69.0E0 END AS delivery_voltage_kv,
         CAST(CASE WHEN o.o_orderkey % 211 = 0 THEN -1 ELSE 1 END * CAST(o.o_totalprice AS DECIMAL(18,2))
              * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(18,2)) AS bill_amount,
         CASE WHEN o.o_custkey % 10 = 0 OR o.o_orderkey % 5 < 3 THEN CAST(0 AS DECIMAL(18,2)) ELSE li.tax END AS sales_tax_amt
  FROM {orders} o JOIN li ON li.l_orderkey = o.o_orderkey),
c AS (SELECT b.*, {explode}(CASE WHEN id % 101 = 0 THEN {array}(0, 100000000000) ELSE {array}(0) END) AS copied FROM b)
SELECT id + copied AS id, bill_account, customer, service_class, bill_date, read_date, days_used,
       billed_kwh, billed_demand, load_factor, billed_rkva, delivery_voltage_kv, bill_amount, sales_tax_amt
FROM c
"""

ADJUSTMENT_RATES = """
SELECT CASE p_partkey % 4 WHEN 0 THEN 'tra' WHEN 1 THEN 'rdm' WHEN 2 THEN 'sbc' ELSE 'ram' END AS rate_type,
       p_partkey AS id,
       make_date(CAST(1995 + p_partkey % 7 AS INT), CAST(1 + (p_partkey * 7 + p_size) % 12 AS INT),
                 CAST(1 + p_partkey % 28 AS INT)) AS effective_date,
       CASE p_size % 5 WHEN 0 THEN 'SC1' WHEN 1 THEN 'SC1C' WHEN 2 THEN 'SC2' WHEN 3 THEN 'SC2D' ELSE 'SC3' END AS sc_code,
       CAST(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(0.000001 AS DECIMAL(18,6)) AS DECIMAL(18,6)) AS rate
FROM {part}
"""

USAGE_CALLS = """
SELECT event_id, ts, CASE WHEN event_type IN ('click','view','purchase') THEN 'llm' ELSE 'op' END AS kind,
       CASE event_type WHEN 'click' THEN 'gpt-4.1-mini' WHEN 'view' THEN 'gpt-4.1' ELSE event_type END AS key,
       CAST(floor(value * 100) AS BIGINT) AS input_tokens, event_id % 500 AS output_tokens,
       event_id % 9 <> 0 AS success
FROM {events}
"""

LOG_LINES = """
SELECT concat('svc', CAST(event_id % 7 AS STRING), '.', CAST(CAST(floor(event_id / 70000) AS BIGINT) AS STRING), '.log') AS file,
       CAST(floor(event_id / 7) AS BIGINT) % 10000 + 1 AS line_no,
       CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 11 = 0 THEN concat('free text ', CAST(event_id AS STRING))
            ELSE concat(CAST(date_trunc('second', ts) AS STRING), ' | ', CASE event_type WHEN 'error' THEN 'ERROR   ' ELSE 'INFO    ' END,
                        ' | app.', event_type, ' | value=', CAST(event_id % 100 AS STRING)) END AS line
FROM {events}
"""

TARIFF_PAGES = """
SELECT conv_id AS doc_id, CAST(turn AS INT) AS page_number,
       CASE WHEN turn % 3 = 1 THEN concat('Effective Date: 0', CAST(1 + conv_id % 9 AS STRING), '/15/1999', chr(10), 'SERVICE CLASSIFICATION NO. ',
                 CAST(1 + (conv_id + turn) % 4 AS STRING), chr(10), text) ELSE text END AS text
FROM {conversations}
"""

RAW_DOCUMENTS = """
SELECT doc_id AS id, concat(source, '_', CAST(doc_id % 300 AS STRING), '.pdf') AS file_name, '.pdf' AS file_type,
       lang AS source, CASE WHEN doc_id % 4 = 0 THEN 'pending' ELSE 'uploaded' END AS status
FROM {documents}
"""

# One tariff object per part, in the three shapes a document may have; every seventh document is broken.
TARIFF_DOCS = """
SELECT p_partkey AS doc_id,
       concat('SC', CAST(p_partkey % 40 AS STRING), CASE WHEN p_size % 3 = 0 THEN '-D' ELSE '' END) AS sc_code,
       make_date(CAST(1990 + p_partkey % 31 AS INT), CAST(1 + p_size % 12 AS INT), 1) AS effective_date,
       CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS STRING) AS fee,
       p_partkey % 7 AS shape
FROM {part}
"""
TARIFF_OBJECT = """
concat('{{"sc_code": "', sc_code, '", "description": "class ', sc_code,
       '", "logic_steps": [{{"step_name": "Customer Charge", "charge_type": "fixed_fee", "value": ', fee,
       '}}], "metadata": {{"effective_date": "', CAST(effective_date AS STRING), '", "filename": "t', CAST(doc_id AS STRING), '.pdf"}}}}')
"""
TARIFF_ANSWERS = f"""
SELECT doc_id, sc_code, effective_date, fee, shape,
       CASE shape WHEN 0 THEN o WHEN 1 THEN concat('[', o, ']') WHEN 2 THEN concat('{{{{"tariffs": [', o, ', ', o, ']}}}}')
            WHEN 3 THEN concat('```json', chr(10), o, chr(10), '```') WHEN 4 THEN concat('```', o, '```')
            WHEN 5 THEN concat('Here is the tariff: ', o, ' as asked.') ELSE concat('broken ', fee, ' {{{{"sc_code": ') END AS answer
FROM (SELECT *, {TARIFF_OBJECT.strip()} AS o FROM ({TARIFF_DOCS.strip()}) AS d) AS t
"""

RUN_EVENTS = """
SELECT CAST(floor(event_id / 2) AS BIGINT) AS run_id, concat('dag_', CAST(user_id % 5 AS STRING)) AS dag_id,
       CASE event_id % 2 WHEN 0 THEN 'start' ELSE 'finish' END AS kind,
       CASE event_id % 2 WHEN 0 THEN 'running' ELSE CASE event_type WHEN 'error' THEN 'failed' ELSE 'success' END END AS status,
       ts, CASE WHEN event_id % 2 = 1 AND event_type = 'error' THEN concat('error in ', CAST(event_id AS STRING)) END AS error_msg
FROM {events} WHERE NOT (event_id % 2 = 1 AND event_type = 'signup')
"""

# What is printed in a billing history for each bill, with scan errors in some dates.
BILL_LINES = """
SELECT concat(bill_account, '-', CAST(CAST(floor(id / 50000) AS BIGINT) AS STRING)) AS doc_id, id, bill_account, customer, read_date,
       concat(bill_account, ' ', customer, ' ',
              CASE WHEN month(bill_date) = 10 THEN '1A0R' ELSE CAST(month(bill_date) AS STRING) END,
              CASE WHEN id % 3 = 1 AND month(bill_date) <> 10 THEN ' AB / ' ELSE '/' END,
              CAST(day(bill_date) AS STRING), '/', CAST(year(bill_date) AS STRING),
              CASE WHEN id % 7 = 0 THEN '' ELSE ' ' END,
              CAST(month(read_date) AS STRING),
              CASE WHEN day(read_date) BETWEEN 10 AND 19 AND id % 3 = 0 THEN concat('A/1R', CAST(day(read_date) - 10 AS STRING))
                   ELSE concat('/', CAST(day(read_date) AS STRING)) END, '/', CAST(year(read_date) AS STRING), ' ',
              CAST(days_used AS STRING), ' ', format_number(CAST(billed_kwh AS BIGINT), 0), ' ', CAST(billed_demand AS STRING), ' ',
              CAST(load_factor AS STRING), ' ', CAST(CAST(billed_rkva AS BIGINT) AS STRING), ' $', CAST(bill_amount AS STRING), ' $',
              format_number(sales_tax_amt, 2), ' $', CAST(bill_amount + sales_tax_amt AS STRING),
              CASE WHEN id % 5 = 0 THEN ' $9.99' ELSE '' END, ' $', CAST(CAST(id % 100 AS DECIMAL(4,2)) AS STRING),
              CASE WHEN id % 2 = 0 THEN ' 0.08' ELSE '' END,
              CASE WHEN id % 50 = 0 THEN ' Page 1 of 2' ELSE '' END) AS line
FROM {bills}
"""

# Invented tariffs for the classes of the bills. Charge types and shapes are those a tariff may have; every amount, date and
# tier bound is made up, and the tiers overlap so that their order matters.
_F = "fixed_fee"
PRICING_TARIFFS = [
    *[
        {
            "sc_code": "SC-1",
            "logic_steps": [
                {"step_name": "Customer Charge", "charge_type": _F, "value": fee},
                {"step_name": "Energy Charge", "charge_type": "per_kwh", "value": rate},
            ],
            "metadata": {"effective_date": date},
        }
        for date, fee, rate in (("03/01/1994", 11.5, 0.061), ("09/01/1997", 13.25, 0.068), ("02/01/2000", 17.75, 0.0835))
    ],
    {
        "sc_code": "SC-1C",
        "effective_date": "1998-05-20",
        "logic_steps": [
            {"step_name": "Customer Charge", "charge_type": _F, "value": 27.4},
            {"step_name": "Energy Charge", "charge_type": "energy_charge", "value": 0.0365},
            {"step_name": "Minimum Charge", "charge_type": "minimum_charge", "value": 58},
            {"step_name": "Minimum Bill", "charge_type": "minimum_bill", "value": 81},
        ],
    },
    *[
        {
            "sc_code": "SC2-ND",
            "logic_steps": [
                {"step_name": "Customer Charge", "charge_type": _F, "value": 22.8},
                {
                    "step_name": "Energy Charge",
                    "charge_type": "per_kwh",
                    "value": rate,
                    "condition": "user.billed_kwh > 800",
                },
                {"step_name": "Monthly Minimum", "charge_type": "minimum_monthly_charge", "value": 840},
            ],
            "metadata": {"effective_date": date},
        }
        for date, rate in (("1995-04-01", 0.0915), ("1999-07-01", 0.113))
    ],
    {
        "sc_code": "SC2-D",
        "effective_date": "1995-02-10",
        "logic_steps": [
            {"step_name": "Customer Charge", "charge_type": _F, "value": 71},
            {"step_name": "Demand Charge", "charge_type": "per_kw", "value": 13.6},
            {
                "step_name": "Summer Energy",
                "charge_type": "per_kwh",
                "value": 0.0235,
                "condition": "user.bill_date.month in [6,7,8]",
            },
            {
                "step_name": "Reactive Charge",
                "charge_type": "per_rkva",
                "value": 1.35,
                "condition": "Applies when demand exceeds 500 kW",
            },
        ],
    },
    {
        "sc_code": "SC3",
        "effective_date": "08/01/1996",
        "logic_steps": [
            {
                "step_name": "Customer Charge",
                "charge_type": _F,
                "value": {"Over 50 kV": 905, "3-20 kV": 640, "0-3 kV": 515, "20-50 kV": 810},
            },
            {
                "step_name": "Demand Charge",
                "charge_type": "demand_charge",
                "value": {"Over 12 kV": 6.15, "2-40 kV": 8.6, "0-3 kV": 9.35},
            },
            {"step_name": "Reactive Charge", "charge_type": "per_rkva", "value": 0.62},
            {"step_name": "Credit", "charge_type": "credit", "value": 4},
        ],
    },
]

# The same classes under the older rules: one version each, fees and formulas.
LEGACY_TARIFFS = [
    {
        "sc_code": code,
        "logic_steps": [
            {"step_name": "Customer Charge", "charge_type": _F, "value": fee},
            {"step_name": "Energy Charge", "charge_type": "formula", "python_formula": formula, **extra},
            {"step_name": "Ignored", "charge_type": "per_kwh", "value": 1},
        ],
    }
    for code, fee, formula, extra in (
        ("SC-1", 10, "user.billed_kwh * 0.45", {}),
        ("SC-1", 18, "user.billed_kwh * 0.0912", {}),
        ("SC-1C", 28, "max(user.billed_kwh - 120, 0) * 0.06 + min(user.billed_demand, 12) * 1.75", {}),
        ("SC2-ND", 23, "user.billed_kwh * 0.105", {"condition": "user.days_used >= 30 and user.bill_date.year > 1996"}),
        ("SC2-D", 60, "user.billed_demand * unknown", {}),
    )
]


def view_sql() -> dict[str, str]:
    """View name → SELECT with ``{table}`` in place of each given table."""
    return {
        "bills": BILLS,
        "adjustment_rates": ADJUSTMENT_RATES,
        "usage_calls": USAGE_CALLS,
        "log_lines": LOG_LINES,
        "tariff_pages": TARIFF_PAGES,
        "raw_documents": RAW_DOCUMENTS,
        "tariff_docs": TARIFF_DOCS,
        "tariff_answers": TARIFF_ANSWERS,
        "run_events": RUN_EVENTS,
    }


TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table over the Parquet tables in ``sf_dir``."""
    sql = view_sql()[name].replace("{explode}", "explode").replace("{array}", "array")
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def duckdb_sql(name: str) -> str:
    """The same SELECT for DuckDB, where each given table is a view of its own name."""
    sql = view_sql()[name].replace("{explode}", "unnest").replace("{array}", "list_value")
    return sql.format(**{t: t for t in TABLES}).strip()


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "bills")


def tariff_json(spark: SparkSession, tariffs: list[dict]) -> DataFrame:
    """One document (doc_id, body) holding the given tariffs."""
    return spark.range(1).select(F.lit(1).alias("doc_id"), F.lit(json.dumps({"tariffs": tariffs})).alias("body"))


def bill_documents(bills: DataFrame) -> DataFrame:
    """Billing histories as text (doc_id, text): a header, then a line per bill.

    A document holds the bills of one account within 50,000 consecutive ids, so its size is bounded.
    """
    lines = bills.sparkSession.sql(BILL_LINES, bills=bills)
    ordered = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("read_date", "id", "line"))), lambda s: s["line"]), "\n"
    )
    return lines.groupBy("doc_id", "bill_account", "customer").agg(ordered.alias("lines")).select(
        "doc_id",
        F.concat(
            F.lit("Monthly Electric History\nCustomer: "), F.left("customer", F.lit(12)), F.lit(" Bill Account: "),
            F.col("bill_account"), F.lit("\nService Address: on file\n"), F.col("lines"), F.lit("\nPage 2 of 2\n"),
        ).alias("text"),
    )




def named_documents(bills: DataFrame) -> DataFrame:
    """Billing histories (doc_id, text) whose headers begin the name, misspell it, are unrelated or missing, by account; in
    every third bill the name lacks its legal form.
    """
    name = F.when(F.col("id") % 3 == 0, F.regexp_replace("customer", r" INC\.$", "")).otherwise(F.col("customer"))
    day = F.date_format("read_date", "M/d/yyyy")
    line = F.concat_ws(" ", "bill_account", name, day, day, F.lit("30"))
    misspelt = F.replace(F.replace("customer", F.lit("CUSTOMER"), F.lit("CUSTOMRE")), F.lit("TOWN"), F.lit("TWON"))
    headers = [F.left("customer", F.lit(12)), misspelt, F.lit("ZZ HOLDINGS")]
    header = F.get(F.array(*[F.concat(F.lit("Customer: "), h, F.lit(" ")) for h in headers], F.lit("")), (F.col("bill_account").cast("long") % 4).cast("int"))
    lines = bills.select("bill_account", header.alias("header"), F.floor(F.col("id") / 50_000).alias("part"), "id", line.alias("line"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "line"))), lambda s: s["line"]), "\n")
    return lines.groupBy("bill_account", "header", "part").agg(joined.alias("lines")).select(
        F.concat_ws("-", "bill_account", F.col("part").cast("string")).alias("doc_id"),
        F.concat(F.lit("History\n"), "header", F.lit("Bill Account: "), "bill_account", F.lit("\nService Address: on file\n"), "lines", F.lit("\nPage 1 of 1\n")).alias("text"),
    )
