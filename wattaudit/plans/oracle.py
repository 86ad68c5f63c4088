"""The same results as ``queries``, as SQL that DuckDB runs on the given tables.

Written from the meaning of each operator with plain joins and windows, not from the Spark plans.
"""

from __future__ import annotations

import hashlib
import re

from wattaudit.functions.values import CLASS_LABELS, MUNICIPAL_WORDS
from wattaudit.operators.usage import PRICES
from wattaudit.plans import queries as q
from wattaudit.sources import views

ORACLE: dict[str, str] = {}


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _with(ctes: dict[str, str], select: str) -> str:
    parts = ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in ctes.items())
    return f"WITH {parts}\n{select.strip()}"


def _views(*names: str) -> dict[str, str]:
    return {n: views.duckdb_sql(n) for n in names}


def dbl(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


def txt(*names: str) -> str:
    return ", ".join(f"CAST({n} AS VARCHAR) AS {n}" for n in names)


BILL = _views("bills")
BILL_OUT = f"""id, bill_account, customer, service_class, {txt('bill_date', 'read_date')}, days_used, billed_kwh, billed_demand,
 load_factor, billed_rkva, delivery_voltage_kv, {dbl('bill_amount', 'sales_tax_amt')}"""
STORED_OUT = f"""id, bill_account, customer, {txt('bill_date', 'read_date')}, days_used, billed_kwh, billed_demand,
 load_factor, billed_rkva, {dbl('bill_amount', 'sales_tax_amt')}"""
NORM = "upper(replace(replace(service_class, ' ', ''), '-', ''))"

# ---- tariff literals


def _tier(label: str) -> tuple[float, str]:
    numbers = re.findall(r"\d+(?:\.\d+)?", label)
    if label.startswith("Over"):
        return float(numbers[0]), "CAST('Infinity' AS DOUBLE)"
    return float(numbers[0]), numbers[1]


def _iso(text: str) -> str:
    if "/" in text:
        month, day, year = text.split("/")
        return f"{year}-{month}-{day}"
    return text


def _tariff_ctes() -> dict[str, str]:
    version_rows, step_rows, tier_rows = [], [], []
    for seq, t in enumerate(views.PRICING_TARIFFS):
        date = _iso(t.get("effective_date") or t["metadata"]["effective_date"])
        version_rows.append(f"({seq}, '{t['sc_code'].replace('-', '')}', DATE '{date}')")
        for pos, s in enumerate(t["logic_steps"]):
            tiers = s["value"] if isinstance(s["value"], dict) else {}
            number = "NULL" if tiers else str(s["value"])
            condition = _quote(s["condition"]) if "condition" in s else "'Always'"
            step_rows.append(
                f"({seq}, {pos}, {_quote(s['step_name'])}, '{s['charge_type']}', CAST({number} AS DECIMAL(18,6)), {condition})"
            )
            for place, (label, rate) in enumerate(tiers.items()):
                low, high = _tier(label)
                tier_rows.append(f"({seq}, {pos}, {place}, {low}, CAST({high} AS DOUBLE), CAST({rate} AS DECIMAL(18,6)))")
    return {
        "versions(seq, sc, eff)": "VALUES " + ", ".join(version_rows),
        "steps(seq, pos, step_name, kind, num, cond)": "VALUES " + ", ".join(step_rows),
        "tiers(seq, pos, place, low, high, rate)": "VALUES " + ", ".join(tier_rows),
        "spans": """SELECT seq, sc, eff, lead(eff) OVER (PARTITION BY sc ORDER BY eff) AS nxt,
            row_number() OVER (PARTITION BY sc ORDER BY eff) AS place FROM versions""",
    }


TARIFF = _tariff_ctes()
PICK = {
    **BILL,
    **TARIFF,
    "picked": f"""SELECT b.*, {NORM} AS sc_code, v.seq, v.eff FROM bills b LEFT JOIN spans v
        ON v.sc = {NORM} AND (v.place = 1 OR v.eff <= b.DATE_COLUMN) AND (v.nxt IS NULL OR b.DATE_COLUMN < v.nxt)""",
}


def _pick(date: str = "read_date") -> dict[str, str]:
    return {n: s.replace("DATE_COLUMN", date) for n, s in PICK.items()}


HOLDS = """CASE s.cond WHEN 'Always' THEN true WHEN 'user.billed_kwh > 800' THEN p.billed_kwh > 800
  WHEN 'user.bill_date.month in [6,7,8]' THEN month(p.DATE_COLUMN) IN (6, 7, 8) ELSE false END"""
MONTHLY = {
    **_views("adjustment_rates"),
    "newest": """SELECT rate_type, sc_code, date_trunc('month', effective_date) AS month, id, effective_date, rate
        FROM adjustment_rates
        QUALIFY row_number() OVER (PARTITION BY rate_type, sc_code, date_trunc('month', effective_date)
                                   ORDER BY effective_date DESC, id DESC) = 1""",
}


def _rate_joins(sc: str, date: str, *kinds: str) -> str:
    return " ".join(
        f"LEFT JOIN newest {k} ON {k}.rate_type = '{k}' AND {k}.sc_code = {sc} AND {k}.month = date_trunc('month', {date})"
        for k in kinds
    )


def _pricing(date: str = "read_date", rates: bool = True) -> dict[str, str]:
    kwh, kw, rkva = (f"CAST(p.{c} AS DECIMAL(18,4))" for c in ("billed_kwh", "billed_demand", "billed_rkva"))
    rate_code = "CASE p.sc_code WHEN 'SC2ND' THEN 'SC2' ELSE p.sc_code END"
    price = """coalesce(s.num, (SELECT first(t.rate ORDER BY t.place) FROM tiers t WHERE t.seq = s.seq AND t.pos = s.pos
        AND t.low <= p.delivery_voltage_kv AND p.delivery_voltage_kv <= t.high), 0)"""
    ctes = {
        **_pick(date),
        **(MONTHLY if rates else {}),
        "lines": f"""SELECT p.id, s.pos, s.step_name, s.kind, s.num,
            CAST(CASE WHEN kind = 'fixed_fee' THEN CAST({price} AS DECIMAL(18,6)) * CAST(1 AS DECIMAL(18,4))
                 WHEN kind IN ('per_kwh', 'energy_charge') THEN CAST({price} AS DECIMAL(18,6)) * {kwh}
                 WHEN kind IN ('per_kw', 'demand_charge') THEN CAST({price} AS DECIMAL(18,6)) * {kw}
                 WHEN kind IN ('per_rkva', 'reactive_demand_fee') THEN CAST({price} AS DECIMAL(18,6)) * {rkva} END AS DECIMAL(38,10)) AS cost
            FROM picked p JOIN steps s ON s.seq = p.seq WHERE {HOLDS.replace('DATE_COLUMN', date)}""",
        "sums": """SELECT id, coalesce(sum(cost), 0) AS total,
            max(CASE WHEN kind IN ('minimum_charge', 'minimum_bill') THEN num END) AS minimum,
            coalesce(string_agg(kind, '|' ORDER BY pos) FILTER (cost IS NULL AND kind NOT IN ('minimum_charge', 'minimum_bill')), '') AS unpriced,
            string_agg(concat(step_name, ': $', CAST(CAST(cost AS DECIMAL(18,2)) AS VARCHAR)), '|' ORDER BY pos) FILTER (cost IS NOT NULL) AS trace
            FROM lines GROUP BY id""",
    }
    energy = f"{rate_code} IN ('SC1', 'SC1C', 'SC2')"
    demand = f"{rate_code} IN ('SC2D', 'SC3', 'SC3A')"
    if rates:
        added = f"""coalesce(tra.rate, 0) AS tra, coalesce(rdm.rate, 0) AS rdm,
            CAST(coalesce(tra.rate, 0) AS DECIMAL(18,6)) * {kwh} AS tra_cost,
            CAST(coalesce(rdm.rate, 0) AS DECIMAL(18,6)) * CASE WHEN {energy} THEN {kwh} WHEN {demand} THEN {kw} ELSE 0 END AS rdm_cost"""
        joins = _rate_joins(rate_code, f"p.{date}", "tra", "rdm")
    else:
        added, joins = "0 AS tra, 0 AS rdm, CAST(0 AS DECIMAL(28,10)) AS tra_cost, CAST(0 AS DECIMAL(28,10)) AS rdm_cost", ""
    ctes["summed"] = f"""SELECT p.*, s.minimum, s.unpriced, s.trace AS step_trace, {added}, {energy} AS by_energy,
        {energy} OR {demand} AS by_any, s.total FROM picked p LEFT JOIN sums s ON s.id = p.id {joins}"""
    ctes["totals"] = """SELECT *, CAST(total + tra_cost + rdm_cost AS DECIMAL(38,10)) AS before FROM summed"""
    ctes["priced"] = f"""SELECT *, {date} AS priced_date,
        CASE WHEN seq IS NULL THEN 'SKIPPED' ELSE 'SUCCESS' END AS status,
        CASE WHEN seq IS NULL THEN 0 ELSE CAST(greatest(before, coalesce(minimum, before)) AS DECIMAL(18,2)) END AS expected_bill,
        CASE WHEN seq IS NULL THEN 0 ELSE CAST(bill_amount - CAST(greatest(before, coalesce(minimum, before)) AS DECIMAL(28,10)) AS DECIMAL(18,2)) END AS variance,
        concat_ws('|', step_trace,
          CASE WHEN tra <> 0 THEN concat('TRA Override: ', CAST(CAST(tra AS DECIMAL(18,5)) AS VARCHAR), ' × ',
               CAST(CAST(billed_kwh AS DECIMAL(18,2)) AS VARCHAR), ' kWh = $', CAST(CAST(tra_cost AS DECIMAL(18,2)) AS VARCHAR)) END,
          CASE WHEN rdm <> 0 AND by_any THEN concat('RDM Override (', CASE WHEN by_energy THEN 'Energy' ELSE 'Demand' END, '): ',
               CAST(CAST(rdm AS DECIMAL(18,5)) AS VARCHAR), ' × ',
               CAST(CAST(CASE WHEN by_energy THEN billed_kwh ELSE billed_demand END AS DECIMAL(18,2)) AS VARCHAR),
               CASE WHEN by_energy THEN ' kWh = $' ELSE ' kW = $' END, CAST(CAST(rdm_cost AS DECIMAL(18,2)) AS VARCHAR)) END,
          CASE WHEN before < minimum THEN concat('Minimum bill enforced: $', CAST(CAST(minimum AS DECIMAL(18,2)) AS VARCHAR)) END) AS trace
        FROM totals"""
    return ctes


PRICED = _pricing()
AUDITED = _pricing("bill_date", rates=False)
PRICED_OUT = f"""id, bill_account, CAST(priced_date AS VARCHAR) AS bill_date, sc_code, CAST(bill_amount AS DOUBLE) AS actual_bill,
    {dbl('expected_bill', 'variance')}, status"""

# ---- scans, sources, sinks

ORACLE["a1_bills"] = _with(BILL, f"SELECT {BILL_OUT} FROM bills")
ANSWERS = _views("tariff_docs")
# Objects per document: shape 2 holds two; shape 6 holds none.
OBJECTS = {
    **ANSWERS,
    "objects": """SELECT doc_id, pos, sc_code, effective_date, CAST(fee AS DOUBLE) AS fee, shape,
        replace(sc_code, '-', '') AS norm_code FROM tariff_docs JOIN (VALUES (0), (1)) AS p(pos)
        ON shape <> 6 AND (pos = 0 OR shape = 2)""",
}
ORACLE["a2_tariff_versions"] = _with(
    OBJECTS,
    f"""SELECT doc_id, pos, sc_code, norm_code, {txt('effective_date')}, 1 AS n_steps, fee FROM objects WHERE shape < 3""",
)
ORACLE["a3_doc_pages"] = _with(
    _views("tariff_pages"),
    """SELECT concat_ws('-', doc_id, page_number) AS doc_id, page_number, text,
    CASE WHEN page_number % 3 <> 0 THEN concat('[[["row ', page_number, '","', doc_id, '"]]]') END AS "tables" FROM tariff_pages""",
)
ORACLE["a4_csv_bills"] = ORACLE["a5_json_bills"] = _with(BILL, f"SELECT {STORED_OUT} FROM bills")
LOGGED = {
    **_views("log_lines"),
    "parsed": r"""SELECT *, regexp_matches(line, '^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\s*\|\s*[A-Z]+\s*\|') AS fits
        FROM log_lines WHERE trim(line) <> ''""",
}
ORACLE["a6_parse_logs"] = _with(
    LOGGED,
    """SELECT 'app' AS source, CASE WHEN fits THEN left(line, 19) END AS event_time,
    CASE WHEN fits THEN trim(split_part(line, '|', 2)) ELSE 'INFO' END AS level,
    CASE WHEN fits THEN trim(split_part(line, '|', 3)) END AS logger_name,
    CASE WHEN fits THEN trim(split_part(line, '|', 4)) END AS description,
    line AS message, file AS log_file, line_no, CAST(line_no AS VARCHAR) AS noted FROM parsed""",
)
ORACLE["a6_log_files"] = ORACLE["a6_parse_logs"]
ORACLE["a7_append_bills"] = _with(
    BILL,
    f"""SELECT id % 1000 AS raw_bill_document_id, bill_account, customer, {txt('bill_date', 'read_date')}, days_used, billed_kwh,
    billed_demand, load_factor, billed_rkva, {dbl('bill_amount', 'sales_tax_amt')}, CAST(NULL AS DOUBLE) AS bill_amount_with_sales_tax,
    CAST(NULL AS DOUBLE) AS retracted_amt, CAST(NULL AS DOUBLE) AS sales_tax_factor,
    CASE WHEN id % 7 > 0 THEN service_class END AS service_class, delivery_voltage_kv,
    concat(CAST(read_date AS VARCHAR), ' 00:00:00') AS created_at FROM bills JOIN (VALUES (1), (2)) AS twice(n) ON true""",
)
ORACLE["a8_list_documents"] = " UNION ALL ".join(f"SELECT '{t}.parquet' AS file_name, count(*) AS n_rows FROM {t}" for t in views.TABLES)
ACCOUNT = "bill_account = '1120000100'"
ORACLE["a1_account_bills"] = _with(BILL, f"SELECT {BILL_OUT} FROM bills WHERE {ACCOUNT}")
STORED = {**AUDITED, "bills": f"SELECT * REPLACE (CASE WHEN id % 7 > 0 THEN service_class ELSE 'SC1' END AS service_class) FROM ({views.duckdb_sql('bills')})"}
ORACLE["e4_stored_audit"] = _with(STORED, f"SELECT {PRICED_OUT.removeprefix('id, ')}, unpriced AS unpriced_steps FROM priced")
ORACLE["e4_account_audit"] = _with(AUDITED, f"SELECT {PRICED_OUT}, unpriced AS unpriced_steps FROM priced WHERE {ACCOUNT}")
ORACLE["a9_export_results"] = _with(
    PRICED,
    """SELECT CAST(read_date AS VARCHAR) AS "Bill Date", sc_code AS "Service Class", billed_kwh AS "kWh",
    billed_demand AS "Demand (kW)", CAST(tra AS DOUBLE) AS "TRA", CAST(rdm AS DOUBLE) AS "RDM", CAST(bill_amount AS DOUBLE) AS "Actual Bill",
    CAST(expected_bill AS DOUBLE) AS "Expected Bill", CAST(variance AS DOUBLE) AS "Variance", status AS "Status" FROM priced""",
)

ORACLE["a9_export_bills"] = _with(
    BILL,
    """SELECT id AS "Bill ID", bill_account AS "Bill Account", customer AS "Customer", CAST(bill_date AS VARCHAR) AS "Bill Date",
    CAST(read_date AS VARCHAR) AS "Read Date", days_used AS "Days Used", billed_kwh AS "Billed kWh", billed_demand AS "Billed Demand",
    load_factor AS "Load Factor", billed_rkva AS "Billed rKVA", CAST(bill_amount AS DOUBLE) AS "Bill Amount",
    CAST(sales_tax_amt AS DOUBLE) AS "Sales Tax Amount" FROM bills""",
)

# ---- projections and cleaning

ORACLE["b1_clean_columns"] = _with(
    BILL,
    """SELECT id, CAST(read_date AS VARCHAR) AS read_date, billed_kwh AS kwh, billed_demand AS kw_demand,
    CAST(bill_amount AS DOUBLE) AS amount_due, service_class AS rate_class FROM bills""",
)
ORACLE["b1_strip_columns"] = _with(BILL, "SELECT id, CAST(bill_amount AS DOUBLE) AS bill_amount FROM bills")
ORACLE["b2_resolve_columns"] = _with(
    BILL,
    """SELECT id, CAST(read_date AS VARCHAR) AS bill_date, billed_kwh, billed_demand, CAST(bill_amount AS DOUBLE) AS bill_amount,
    service_class FROM bills""",
)
ORACLE["b3_conform"] = _with(
    BILL,
    """SELECT id, CAST(read_date AS VARCHAR) AS bill_date, 'SC1' AS service_class, billed_kwh, billed_demand,
    CAST(NULL AS DOUBLE) AS retracted_amt FROM bills""",
)
ORACLE["b4_clean_number"] = _with(
    BILL,
    """SELECT id, CASE WHEN id % 13 <> 0 AND id % 17 <> 0 THEN CAST(bill_amount AS DOUBLE) END AS ingested,
    CASE WHEN id % 13 <> 0 AND id % 17 <> 0 THEN CAST(bill_amount AS DOUBLE) ELSE 0 END AS audited,
    CAST(billed_kwh AS INTEGER) AS whole FROM bills""",
)
ORACLE["b5_parse_date"] = _with(
    BILL, "SELECT id, CASE WHEN id % 5 < 4 THEN CAST(read_date AS VARCHAR) END AS read_date FROM bills"
)
_LABEL_CASE = " ".join(f"WHEN '{label}' THEN '{code}'" for label, code in CLASS_LABELS.items())
ORACLE["b6_norm_sc"] = _with(
    BILL,
    f"""SELECT id, {NORM} AS code, CASE WHEN id % 3 = 0 THEN {NORM} ELSE '' END AS code_or_blank,
    CASE service_class {_LABEL_CASE} ELSE {NORM} END AS code_of_label FROM bills""",
)
ORACLE["b7_month_start"] = _with(
    _views("adjustment_rates"),
    "SELECT rate_type, id, CAST(CAST(date_trunc('month', effective_date) AS DATE) AS VARCHAR) AS month FROM adjustment_rates",
)


def municipal(name: str) -> str:
    return "(" + " OR ".join(f"contains(upper({name}), '{w}')" for w in MUNICIPAL_WORDS) + ")"


ORACLE["b8_municipality"] = _with(
    BILL,
    f"""SELECT id, CASE WHEN id % 7 = 0 THEN true WHEN id % 11 = 0 THEN false ELSE {municipal('customer')} END
    AS is_municipality FROM bills""",
)


def token(prefix: str, value: str) -> str:
    raw = q.KEY.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in raw).hex(), bytes(b ^ 0x5C for b in raw).hex()
    digest = f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode(trim({value})))))"
    return f"concat('{prefix}_', left({digest}, 12))"


ORACLE["b9_tokenize"] = _with(
    BILL,
    f"""SELECT id, {token('ACCT', 'bill_account')} AS account_token,
    CASE WHEN id % 4 <> 0 THEN {token('NAME', 'customer')} ELSE 'NAME_UNKNOWN' END AS name_token FROM bills""",
)
_AMOUNT = "CAST(CAST(bill_amount AS DOUBLE) AS VARCHAR)"
PAYLOADS = {
    **BILL,
    "payloads": f"""SELECT id, concat('{{"account_token":"', {token('ACCT', 'bill_account')}, '","rate_schedule":"', service_class,
    '","billing_period":{{"start":null,"end":"', CAST(read_date AS VARCHAR), '"}},"usage_kwh":', CAST(billed_kwh AS VARCHAR),
    ',"demand_kw":', CAST(billed_demand AS VARCHAR), ',"charges":[{{"description":"Energy","amount":', {_AMOUNT},
    ',"rate_code":null}}],"total_due":', CAST(bill_amount AS VARCHAR),
    CASE WHEN id % 2 = 0 THEN ',"zip_code":"12207"' ELSE '' END,
    CASE WHEN id % 3 = 0 THEN concat(',"meter_token":"', {token('METER', "concat('M', bill_account)")}, '"') ELSE '' END,
    '}}') AS payload FROM bills""",
}
ORACLE["b10_safe_payload"] = _with(PAYLOADS, "SELECT id, payload FROM payloads")
ORACLE["b11_no_pii"] = _with(PAYLOADS, "SELECT id, CAST(length(payload) AS INTEGER) AS n_chars FROM payloads")
ORACLE["b11_leaked_fields"] = _with(
    BILL,
    """SELECT id, CASE WHEN id % 2 = 0 THEN 'account_number|customer_name' ELSE 'account_number' END AS leaked FROM bills""",
)
ORACLE["b12_qc_facts"] = _with(
    BILL,
    f"""SELECT id AS bill_id, CAST(NULL AS VARCHAR) AS period_start, CAST(read_date AS VARCHAR) AS period_end, days_used AS bill_days,
    billed_kwh AS kwh_usage, billed_demand AS kw_demand, CAST(bill_amount AS DOUBLE) AS total_amount,
    CAST(sales_tax_amt AS DOUBLE) AS sales_tax_amount, load_factor, {municipal('customer')} AS is_municipality, false AS is_holiday_month,
    max(billed_demand) OVER (PARTITION BY bill_account) > 0 AS account_has_real_demand,
    {token('ACCT', 'bill_account')} AS account_token FROM bills""",
)


def _price(place: int) -> str:
    cases = " ".join(f"WHEN '{m}' THEN CAST({p[place]} AS DECIMAL(10,4))" for m, p in PRICES.items())
    return f"CASE key {cases} ELSE 0 END"


COSTS = {
    **_views("usage_calls"),
    "costs": f"""SELECT *, CAST(CAST(input_tokens * {_price(0)} AS DECIMAL(28,4)) * CAST(0.000001 AS DECIMAL(6,6))
        + CAST(output_tokens * {_price(1)} AS DECIMAL(28,4)) * CAST(0.000001 AS DECIMAL(6,6)) AS DECIMAL(28,8)) AS cost,
        strftime(ts, '%Y-%m') AS month FROM usage_calls""",
}
ORACLE["b13_usage_cost"] = _with(COSTS, "SELECT event_id, CAST(cost AS DOUBLE) AS cost FROM costs")
ORACLE["b14_nulls_only"] = (
    "SELECT event_id, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN value END AS value FROM events"
)
ORACLE["b14_bad_values"] = """SELECT event_id, 'value' AS bad_columns FROM events WHERE event_id % 5 = 0 OR event_id % 7 = 0
ORDER BY event_id LIMIT 20"""
DOC_OF_BILL = "concat(bill_account, '-', CAST(CAST(floor(id / 50000) AS BIGINT) AS VARCHAR))"
ORACLE["b15_doc_diagnostics"] = _with(
    BILL,
    f"""SELECT {DOC_OF_BILL} AS doc_id, CAST(count(*) + 1 AS INTEGER) AS accounts_found, 1 AS distinct_accounts,
    CAST(count(*) AS INTEGER) AS date_pairs FROM bills GROUP BY ALL""",
)

# ---- rules

ANOMALIES = {
    **BILL,
    "facts": f"""SELECT *, {municipal('customer')} AS municipal, coalesce(sales_tax_amt, 0) = 0 AS untaxed,
        list(billed_kwh) OVER prior AS kwhs, list(bill_amount) OVER prior AS amounts, count(*) OVER prior AS n_prior,
        max(billed_demand) OVER account > 0 AS has_demand, max(sales_tax_amt) OVER account > 0 AS has_tax,
        count(*) FILTER (coalesce(sales_tax_amt, 0) = 0) OVER account AS n_untaxed, count(*) OVER account AS n_bills,
        lag(load_factor) OVER ordered AS load_before, lag(billed_demand) OVER ordered AS demand_before,
        count(*) OVER (PARTITION BY bill_account, read_date) AS n_same
        FROM bills WINDOW account AS (PARTITION BY bill_account), ordered AS (PARTITION BY bill_account ORDER BY read_date, id),
        prior AS (PARTITION BY bill_account ORDER BY read_date, id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)""",
    "medians": """SELECT *, list_sort(kwhs)[(len(kwhs) + 1) // 2] + list_sort(kwhs)[len(kwhs) // 2 + 1] AS kwh2,
        list_sort(amounts)[(len(amounts) + 1) // 2] + list_sort(amounts)[len(amounts) // 2 + 1] AS amount2 FROM facts""",
    "hits": """SELECT bill_account, id, unnest([
        CASE WHEN n_prior >= 3 AND kwh2 > 0 AND 2 * billed_kwh >= 1.5 * kwh2 THEN 0 END,
        CASE WHEN n_prior >= 3 AND kwh2 > 0 AND 2 * billed_kwh <= 0.5 * kwh2 THEN 1 END,
        CASE WHEN n_prior >= 3 AND amount2 > 0 AND 2 * bill_amount >= CAST(1.5 AS DECIMAL(2,1)) * amount2 THEN 2 END,
        CASE WHEN n_prior >= 3 AND amount2 > 0 AND 2 * bill_amount <= CAST(0.5 AS DECIMAL(2,1)) * amount2 THEN 3 END,
        CASE WHEN days_used < 25 OR days_used > 35 THEN 4 END,
        CASE WHEN billed_kwh <= 0 OR billed_demand < 0 OR bill_amount < 0 THEN 5 END,
        CASE WHEN NOT municipal AND untaxed AND has_tax AND n_untaxed * 2 > n_bills THEN 6 END,
        CASE WHEN has_demand AND ((load_before > 0 AND abs(load_factor - load_before) >= load_before * 0.5)
             OR (demand_before > 0 AND abs(billed_demand - demand_before) >= demand_before * 0.5)) THEN 7 END,
        CASE WHEN n_same > 1 THEN 8 END]) AS rule, days_used, read_date FROM medians""",
    "rules(rule, rule_id, severity, risk, fields)": """VALUES (0, 'R1_USAGE_SPIKE', 'medium', true, 'kwh_usage'),
        (1, 'R1_USAGE_DROP', 'medium', false, 'kwh_usage'), (2, 'R1_CHARGE_SPIKE', 'medium', true, 'total_amount'),
        (3, 'R1_CHARGE_DROP', 'medium', false, 'total_amount'), (4, 'R2_BILL_DAYS_OUT_OF_RANGE', 'low', false, 'bill_days'),
        (5, 'R3_ZERO_OR_NEGATIVE_USAGE_OR_CHARGE', 'medium', false, 'kwh_usage|kw_demand|total_amount'),
        (6, 'R4_SALES_TAX_SUSPECT', 'low', false, 'sales_tax_amount'), (7, 'R5_LOAD_FACTOR_SWING', 'medium', false, 'load_factor|kw_demand'),
        (8, 'R6_DUPLICATE_PERIOD', 'high', true, 'period_start|period_end')""",
    "found": """SELECT bill_account AS account, id AS bill_id, rule, rule_id, severity, risk AS is_overcharge_risk, fields AS field_names,
        'new' AS status, days_used, read_date FROM hits JOIN rules USING (rule)""",
}
RULE_TEXT = """CASE WHEN rule = 0 THEN 'usage is at least 1.5 times the median of the previous bills'
    WHEN rule = 1 THEN 'usage is at most 0.5 times the median of the previous bills'
    WHEN rule = 2 THEN 'charge is at least 1.5 times the median of the previous bills'
    WHEN rule = 3 THEN 'charge is at most 0.5 times the median of the previous bills'
    WHEN rule = 4 THEN concat('bill covers ', CAST(days_used AS VARCHAR), ' days, outside 25-35')
    WHEN rule = 5 THEN 'usage is zero or a value is negative'
    WHEN rule = 6 THEN 'account is taxed at times but most of its bills show no sales tax'
    WHEN rule = 7 THEN 'load factor or demand changed by at least 50 percent against the previous bill'
    ELSE concat('another bill of the account ends on ', CAST(read_date AS VARCHAR)) END"""
FOUND_OUT = "account, bill_id, rule_id, severity, is_overcharge_risk, field_names, status"
for _name, _rules in (
    ("f1_r1_spikes", "0, 1, 2, 3"), ("f2_r4_tax", "6"), ("f3_r5_swing", "7"), ("f4_r6_duplicates", "8"), ("g1_r2_days", "4"),
    ("g2_r3_non_positive", "5"), ("g3_detect_anomalies", "0, 1, 2, 3, 4, 5, 6, 7, 8"),
):
    ORACLE[_name] = _with(ANOMALIES, f"SELECT {FOUND_OUT}, {RULE_TEXT} AS message FROM found WHERE rule IN ({_rules})")
ISSUES = {
    **ANOMALIES,
    "issues": f"SELECT bill_id * 9 + rule AS id, account AS account_id, bill_id AS user_bill_id, rule_id AS issue_type, {RULE_TEXT} AS description, read_date AS detected_on, status FROM found",
}
ORACLE["e9_anomaly_summary"] = _with(
    ANOMALIES,
    """SELECT b.bill_account AS account, count(DISTINCT b.id) AS total_bills, count(DISTINCT f.bill_id) AS bills_with_anomalies,
    count(f.bill_id) AS total_anomalies FROM bills b LEFT JOIN found f ON f.bill_id = b.id GROUP BY 1""",
)

# ---- filters

ORACLE["c1_validation_results"] = _with(
    ANOMALIES,
    f"""SELECT bill_id * 9 + rule AS id, account AS account_id, bill_id AS user_bill_id, rule_id AS issue_type, {RULE_TEXT} AS description,
    CAST(read_date AS VARCHAR) AS detected_on, status FROM found ORDER BY read_date DESC, 1 LIMIT 100""",
)
ORACLE["c1_account_results"] = _with(
    ANOMALIES,
    f"""SELECT bill_id * 9 + rule AS id, account AS account_id, bill_id AS user_bill_id, rule_id AS issue_type, {RULE_TEXT} AS description,
    CAST(read_date AS VARCHAR) AS detected_on, status FROM found WHERE account = '1120000100'""",
)
ORACLE["a9_export_issues"] = _with(
    ANOMALIES,
    f"""SELECT f.bill_id AS "Bill ID", f.bill_id AS "Bill ID (FK)", f.bill_id * 9 + rule AS "Issue ID", rule_id AS "Issue Type",
    {RULE_TEXT.replace('days_used', 'f.days_used').replace('read_date', 'f.read_date')} AS "Description", status AS "Status",
    concat(CAST(f.read_date AS VARCHAR)) AS "Detected On", b.bill_account AS "Bill Account", b.customer AS "Customer"
    FROM found f JOIN bills b ON b.id = f.bill_id""",
)
ORACLE["d8_issues_of_bills"] = _with(
    ANOMALIES,
    f"""SELECT bill_id * 9 + rule AS id, account AS account_id, bill_id AS user_bill_id, rule_id AS issue_type, {RULE_TEXT} AS description,
    CAST(read_date AS VARCHAR) AS detected_on, status FROM found WHERE bill_id = (SELECT min(id) FROM bills)""",
)
ORACLE["g3_bill_anomalies"] = _with(
    {
        **ANOMALIES,
        "texts": f"""SELECT account, bill_id, rule_id, concat('{{"rule_id":"', rule_id, '","severity":"', severity, '","is_overcharge_risk":',
            CAST(is_overcharge_risk AS VARCHAR), ',"field_names":["', replace(field_names, '|', '","'), '"],"message":"', {RULE_TEXT}, '"}}') AS t FROM found""",
    },
    """SELECT account, bill_id, concat('[', string_agg(t, ',' ORDER BY rule_id), ']') AS anomalies FROM texts GROUP BY 1, 2""",
)
GRID = {
    **BILL,
    **MONTHLY,
    "grid": f"""SELECT b.id, read_date AS bill_date, billed_kwh, billed_demand, bill_amount, {NORM} AS service_class,
        {', '.join(f'coalesce({t}.rate, 0) AS override_{t}' for t in ('tra', 'rdm', 'sbc', 'ram'))}
        FROM bills b {_rate_joins(NORM, 'read_date', 'tra', 'rdm', 'sbc', 'ram')}""",
    "entries": " UNION ALL ".join(
        f"SELECT id AS seq, '{t}' AS rate_type, service_class AS sc_code, bill_date AS effective_date, override_{t} AS rate FROM grid"
        for t in ("tra", "rdm", "sbc", "ram")
    ),
}
ORACLE["c2_entered_rates"] = _with(
    GRID, f"SELECT seq, rate_type, sc_code, {txt('effective_date')}, {dbl('rate')} FROM entries WHERE rate > 0"
)
ORACLE["c2_rejected_rates"] = _with(
    GRID, "SELECT rate_type, sc_code, count(*) AS n_rejected FROM entries WHERE rate <= 0 GROUP BY 1, 2"
)
REGISTERED = {
    **_views("raw_documents"),
    "registered": "SELECT file_name FROM raw_documents WHERE id IN (SELECT doc_id FROM labels)",
    "fresh": """SELECT * FROM raw_documents WHERE file_name NOT IN (SELECT file_name FROM registered)
        QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY id) = 1""",
}
ORACLE["c3_new_documents"] = _with(REGISTERED, "SELECT id, file_name, file_type, source, status FROM fresh")
ORACLE["c4_drop_undated"] = _with(BILL, "SELECT id, CAST(read_date AS VARCHAR) AS bill_date FROM bills WHERE id % 9 <> 0")
_CONDITION_SQL = (
    "true",
    "billed_kwh > 800",
    "billed_kwh > 800 AND billed_demand <= 40",
    "month(read_date) IN (6, 7, 8)",
    "NOT days_used < 30 OR billed_rkva >= 4",
    "delivery_voltage_kv <= 15",
    "2.2 < delivery_voltage_kv AND delivery_voltage_kv < 60",
    "greatest(billed_kwh, 500) / days_used >= 40",
    "abs(billed_demand - 25) < 10",
    "round_even(billed_kwh / 3, 0) % 2 = 1",
    "CASE WHEN billed_demand <> 0 THEN billed_kwh / billed_demand > 30 END",
    "false",
    "false",
)
ORACLE["c5_conditions"] = _with(
    BILL,
    " UNION ALL ".join(
        f"SELECT {i} AS no, count(*) FILTER ({c}) AS n_held, count(*) AS n_bills FROM bills" for i, c in enumerate(_CONDITION_SQL)
    ),
)
ORACLE["c6_code_mismatch"] = _with(
    OBJECTS,
    """SELECT doc_id, pos, concat('SC', CAST(doc_id % 20 AS VARCHAR)) AS section_code, sc_code FROM objects
    WHERE NOT contains(concat('SC', CAST(doc_id % 20 AS VARCHAR)), sc_code) AND NOT contains(sc_code, concat('SC', CAST(doc_id % 20 AS VARCHAR)))""",
)

# ---- joins

ORACLE["d1_bills_with_issues"] = _with(
    ISSUES,
    f"""SELECT b.id AS bill_id, i.user_bill_id AS fk_user_bill_id, i.id AS issue_id, bill_account, customer, {txt('bill_date', 'read_date')},
    days_used, billed_kwh, billed_demand, load_factor, billed_rkva, {dbl('bill_amount', 'sales_tax_amt')}, CAST(NULL AS DOUBLE) AS bill_amount_with_sales_tax,
    CAST(NULL AS DOUBLE) AS retracted_amt, CAST(NULL AS DOUBLE) AS sales_tax_factor, CAST(NULL AS VARCHAR) AS bill_created_at, i.issue_type, i.description, i.status,
    CAST(i.detected_on AS VARCHAR) AS detected_on FROM bills b JOIN issues i ON i.user_bill_id = b.id""",
)
ORACLE["d2_pick_version"] = _with(
    _pick(), "SELECT id, sc_code AS norm_code, CAST(eff AS VARCHAR) AS effective_date FROM picked"
)
ORACLE["d3_pick_version_strict"] = _with(
    {**BILL, **TARIFF},
    f"""SELECT b.id, {NORM} AS norm_code, CAST(v.eff AS VARCHAR) AS effective_date
    FROM (SELECT *, {NORM} AS sc FROM bills) b ASOF LEFT JOIN versions v ON v.sc = b.sc AND v.eff <= b.read_date""",
)
ORACLE["d4_rates_for_bills"] = _with(
    {**BILL, **MONTHLY},
    f"""SELECT b.id, {', '.join(f'CAST({t}.rate AS DOUBLE) AS override_{t}' for t in ('tra', 'rdm', 'sbc', 'ram'))}
    FROM bills b {_rate_joins(NORM, 'read_date', 'tra', 'rdm', 'sbc', 'ram')}""",
)
ORACLE["d4_override_grid"] = _with(
    GRID,
    f"""SELECT id, {txt('bill_date')}, billed_kwh, billed_demand, service_class,
    {dbl('bill_amount', 'override_tra', 'override_rdm', 'override_sbc', 'override_ram')} FROM grid""",
)
ORACLE["d5_tier_rate"] = _with(
    {**BILL, **TARIFF},
    """SELECT b.id, CAST(coalesce((SELECT first(t.rate ORDER BY t.place) FROM tiers t JOIN versions v USING (seq)
    WHERE v.sc = 'SC3' AND t.pos = 1 AND t.low <= b.delivery_voltage_kv AND b.delivery_voltage_kv <= t.high), 0) AS DOUBLE) AS rate FROM bills b""",
)
ORACLE["d2_carried_version"], ORACLE["d3_carried_version_strict"] = ORACLE["d2_pick_version"], ORACLE["d3_pick_version_strict"]
ORACLE["d5_step_rates"] = _with(
    _pick(),
    """SELECT p.id, p.sc_code AS norm_code, s.pos AS step_no, s.step_name, CAST(coalesce(s.num, (SELECT first(t.rate ORDER BY t.place) FROM tiers t
    WHERE t.seq = s.seq AND t.pos = s.pos AND t.low <= p.delivery_voltage_kv AND p.delivery_voltage_kv <= t.high), 0) AS DOUBLE) AS rate
    FROM picked p JOIN steps s ON s.seq = p.seq""",
)
PLAIN_PRICED = _pricing("read_date", rates=False)
SAVED = {
    **PLAIN_PRICED,
    "sc1": "SELECT eff, nxt, place, s0.num AS fee, s1.num AS rate FROM spans JOIN steps s0 USING (seq) JOIN steps s1 USING (seq) WHERE sc = 'SC1' AND s0.pos = 0 AND s1.pos = 1",
    "newer": """SELECT p.bill_account, p.read_date, p.billed_demand,
        CASE WHEN p.sc_code = 'SC1' THEN CAST(greatest(27.4 + 0.0365 * CAST(p.billed_kwh AS DECIMAL(18,4)), 81) AS DECIMAL(18,2))
             ELSE CAST(n.fee + n.rate * CAST(p.billed_kwh AS DECIMAL(18,4)) AS DECIMAL(18,2)) END AS new_rate_bill
        FROM priced p JOIN sc1 n ON (n.place = 1 OR n.eff <= p.read_date) AND (n.nxt IS NULL OR p.read_date < n.nxt)""",
    "saved": """SELECT bill_account, read_date AS bill_date, strftime(read_date, '%m-%d-%y') AS month, p.billed_demand AS old_demand,
        n.billed_demand AS new_demand, p.billed_kwh AS kwh, p.expected_bill AS old_rate_bill, n.new_rate_bill
        FROM priced p JOIN newer n USING (bill_account, read_date)""",
}
ORACLE["d6_savings"] = _with(
    SAVED,
    f"""SELECT bill_account, {txt('bill_date')}, month, old_demand, new_demand, kwh, {dbl('old_rate_bill', 'new_rate_bill')},
    CAST(old_rate_bill - new_rate_bill AS DOUBLE) AS monthly_savings FROM saved""",
)
ORACLE["d7_attach_tables"] = _with(
    {
        **_views("tariff_pages"),
        "page_lines": "SELECT doc_id, page_number, unnest(string_split(text, chr(10))) AS line FROM tariff_pages",
        "heads": "SELECT doc_id, page_number, line FROM page_lines WHERE line LIKE 'SERVICE%' OR line LIKE 'Effective%'",
    },
    """SELECT doc_id, page_number, CAST(length(text) AS INTEGER) AS n_chars, line AS "table" FROM tariff_pages LEFT JOIN heads USING (doc_id, page_number)""",
)
ORACLE["d8_flag_issues"] = _with(
    ISSUES,
    """SELECT id, CASE WHEN id IN (SELECT user_bill_id FROM issues) THEN 1 ELSE 0 END AS _has_issue FROM bills""",
)
ORACLE["d9_orphan_files"] = ORACLE["i1_unregistered_names"] = _with(REGISTERED, "SELECT file_name FROM fresh")
ORACLE["d10_token_map"] = _with(
    {
        **BILL,
        "known": f"SELECT {token('ACCT', 'account')} AS token, concat('known ', account) AS account_number FROM (SELECT CAST(c_custkey + 1120000000 AS VARCHAR) AS account FROM customer WHERE c_acctbal < 0)",
        "fresh": f"SELECT DISTINCT {token('ACCT', 'bill_account')} AS token, bill_account AS account_number FROM bills",
    },
    """SELECT token, account_number FROM known UNION ALL
    SELECT token, account_number FROM fresh WHERE token NOT IN (SELECT token FROM known)""",
)
ORACLE["d11_sc_codes"] = _with(OBJECTS, "SELECT DISTINCT sc_code FROM objects ORDER BY 1")
LOGIC = """concat('{"description":"class ', sc_code, '","logic_steps":[{"charge_type":"fixed_fee","step_name":"Customer Charge","value":',
    FEE_TEXT, '}],"sc_code":"', sc_code, '"}')""".replace("FEE_TEXT", "fee_text")
WITH_LOGIC = {
    **OBJECTS,
    "logics": rf"""SELECT o.*, {LOGIC} AS logic FROM (SELECT o.*, regexp_replace(d.fee, '\.?0+$', '') AS fee_text FROM objects o JOIN tariff_docs d USING (doc_id)) o""",
}
ORACLE["d11_all_versions"] = _with(WITH_LOGIC, f"SELECT doc_id, pos, sc_code, {txt('effective_date')}, logic FROM logics")
ORACLE["d11_versions_of_class"] = _with(
    OBJECTS, f"SELECT {txt('effective_date')} FROM objects WHERE sc_code = 'SC7' ORDER BY 1 DESC"
)
ORACLE["d11_logic_of"] = _with(
    OBJECTS, "SELECT doc_id, pos, fee FROM objects WHERE sc_code = 'SC7' AND effective_date = DATE '1997-06-01'"
)

# ---- aggregates

ORACLE["e1_expected_bill"] = _with(PRICED, f"SELECT {PRICED_OUT}, unpriced AS unpriced_steps FROM priced")
ORACLE["e2_trace"] = _with(PRICED, "SELECT id, trace FROM priced")
ORACLE["e3_expected_bill_legacy"] = _with(
    {
        **BILL,
        "old": """SELECT *, CASE service_class
            WHEN 'SC-1' THEN 18 + CAST(billed_kwh * 0.0912E0 AS DECIMAL(28,10))
            WHEN 'SC-1C' THEN 28 + CAST(greatest(billed_kwh - 120, 0) * 0.06E0 + least(billed_demand, 12) * 1.75E0 AS DECIMAL(28,10))
            WHEN 'SC2-ND' THEN 23 + CASE WHEN days_used >= 30 AND year(bill_date) > 1996 THEN CAST(billed_kwh * 0.105E0 AS DECIMAL(28,10)) ELSE 0 END
            WHEN 'SC2-D' THEN CAST(60 AS DECIMAL(28,10)) END AS total FROM bills""",
    },
    """SELECT id, bill_account, service_class AS sc_code, CAST(bill_amount AS DOUBLE) AS actual_bill,
    CAST(coalesce(CAST(total AS DECIMAL(18,2)), 0) AS DOUBLE) AS expected_bill,
    CAST(coalesce(CAST(total - bill_amount AS DECIMAL(18,2)), 0) AS DOUBLE) AS variance,
    CASE WHEN total IS NULL THEN 'SKIPPED' ELSE 'SUCCESS' END AS status FROM old""",
)
ORACLE["e4_audit"] = _with(AUDITED, f"SELECT {PRICED_OUT}, unpriced AS unpriced_steps FROM priced")
ORACLE["e5_audit_summary"] = _with(
    AUDITED,
    """SELECT bill_account, count(*) AS total_bills, CAST(sum(variance) AS DOUBLE) AS total_variance,
    count(*) FILTER (abs(variance) > 0.05) AS high_variance_bills, count(*) FILTER (status <> 'SUCCESS') AS calculation_errors,
    grouping(bill_account) = 1 AS is_total FROM priced GROUP BY ROLLUP (bill_account)""",
)
ORACLE["e6_report_totals"] = _with(
    PRICED,
    """SELECT CAST(sum(bill_amount) AS DOUBLE) AS total_actual, CAST(sum(expected_bill) AS DOUBLE) AS total_expected,
    CAST(sum(variance) AS DOUBLE) AS total_variance FROM priced""",
)
ORACLE["e7_savings_totals"] = _with(
    SAVED,
    """SELECT CAST(sum(old_rate_bill) AS DOUBLE) AS old_total, CAST(sum(new_rate_bill) AS DOUBLE) AS new_total,
    CAST(sum(old_rate_bill - new_rate_bill) AS DOUBLE) AS total_savings FROM saved""",
)
ORACLE["e8_accounts"] = _with(BILL, "SELECT DISTINCT bill_account FROM bills ORDER BY 1")
ORACLE["e10_model_usage"] = _with(
    COSTS,
    """SELECT month, key AS model, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
    CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens,
    CAST(sum(cost) AS DOUBLE) AS cost, grouping(key) = 1 AS is_total FROM costs WHERE kind = 'llm' GROUP BY GROUPING SETS ((month, key), (month))""",
)
ORACLE["e11_operation_usage"] = _with(
    COSTS,
    """SELECT month, key AS operation, count(*) AS requests, count(*) FILTER (success) AS success,
    count(*) FILTER (NOT success) AS failures, grouping(key) = 1 AS is_total FROM costs WHERE kind = 'op' GROUP BY GROUPING SETS ((month, key), (month))""",
)
ORACLE["e12_override_counts"] = _with(
    GRID, "SELECT upper(rate_type) AS rate_type, count(*) AS n_saved FROM entries WHERE rate > 0 GROUP BY 1"
)
ORACLE["e13_canonical_customer"] = _with(BILL, f"SELECT DISTINCT {DOC_OF_BILL} AS doc_id, customer FROM bills")
ORACLE["e13_account_customers"] = _with(
    {
        **BILL,
        "named": r"""SELECT bill_account, customer, CASE WHEN id % 3 = 0 THEN regexp_replace(customer, ' INC\.$', '') ELSE customer END AS name FROM bills""",
        "counted": "SELECT bill_account, customer, name, count(*) AS n FROM named GROUP BY ALL",
        "ranked": "SELECT *, row_number() OVER (PARTITION BY bill_account ORDER BY n DESC, length(name) DESC, name) AS place FROM counted",
    },
    """SELECT bill_account, CASE WHEN CAST(bill_account AS BIGINT) % 4 = 1 AND bool_or(name = customer) THEN any_value(customer)
    ELSE max(name) FILTER (place = 1) END AS customer FROM ranked GROUP BY bill_account""",
)
_RULE, _THIN = "repeat('=', 80)", "repeat('-', 80)"
_MONEY = "CAST(CAST({} AS DECIMAL(28,2)) AS VARCHAR)".format
ORACLE["e14_report_lines"] = _with(
    {
        **AUDITED,
        "numbered": "SELECT *, row_number() OVER (PARTITION BY bill_account ORDER BY bill_date, id) AS bill_no FROM priced",
        "blocks": f"""SELECT bill_account, bill_no, list_concat([concat('Bill #', CAST(bill_no AS VARCHAR), ':'),
            concat('  Date: ', CAST(bill_date AS VARCHAR)), concat('  Service Class: ', sc_code), concat('  Account: ', bill_account),
            concat('  Actual Amount: $', {_MONEY('bill_amount')}), concat('  Expected Amount: $', {_MONEY('expected_bill')}),
            concat('  Variance: $', {_MONEY('variance')}), concat('  Status: ', status), '  Calculation Trace:'],
            list_transform(string_split(trace, '|'), lambda x: concat('    - ', x)), ['']) AS block FROM numbered""",
        "heads": f"""SELECT bill_account, 0 AS bill_no, [{_RULE}, 'BILL AUDIT REPORT', {_RULE}, concat('Account ID: ', bill_account),
            'Generated: {q.GENERATED}', concat('Total Bills Audited: ', CAST(count(*) AS VARCHAR)), {_RULE}, '', 'SUMMARY:',
            concat('  Total Variance: $', {_MONEY('sum(variance)')}),
            concat('  High Variance Bills (>5%): ', CAST(count(*) FILTER (abs(variance) > 0.05) AS VARCHAR)),
            concat('  Calculation Errors: ', CAST(count(*) FILTER (status <> 'SUCCESS') AS VARCHAR)), '', {_THIN}, '', 'DETAILED RESULTS:', '']
            AS block FROM priced GROUP BY bill_account""",
        "tails": f"SELECT bill_account, count(*) + 1 AS bill_no, [{_RULE}, 'END OF REPORT', {_RULE}] AS block FROM priced GROUP BY bill_account",
        "everything": "SELECT * FROM blocks UNION ALL SELECT * FROM heads UNION ALL SELECT * FROM tails",
    },
    """SELECT bill_account, bill_no, CAST(generate_subscripts(block, 1) - 1 AS INTEGER) AS line_no, unnest(block) AS line FROM everything""",
)

_REPORT = ORACLE["e14_report_lines"]
ORACLE["e14_report_file"] = _REPORT[: _REPORT.rindex("SELECT bill_account, bill_no,")] + f"SELECT unnest(block) AS line FROM everything WHERE {ACCOUNT}"

# ---- windows

ORACLE["f5_latest_month_rate"] = _with(
    MONTHLY,
    f"SELECT rate_type, sc_code, CAST(CAST(month AS DATE) AS VARCHAR) AS month, id, {txt('effective_date')}, {dbl('rate')} FROM newest",
)
ORACLE["f6_version_intervals"] = _with(
    {
        **OBJECTS,
        "firsts": "SELECT norm_code, effective_date, min(doc_id) AS doc_id FROM objects GROUP BY 1, 2",
        "ordered": """SELECT *, row_number() OVER w AS place, lead(effective_date) OVER w AS nxt FROM firsts
            WINDOW w AS (PARTITION BY norm_code ORDER BY effective_date)""",
    },
    """SELECT norm_code, CAST(effective_date AS VARCHAR) AS effective_date, doc_id,
    CASE WHEN place > 1 THEN CAST(effective_date AS VARCHAR) END AS valid_from, CAST(nxt AS VARCHAR) AS valid_to, nxt IS NULL AS is_last FROM ordered""",
)
SECTIONS = {
    **_views("tariff_pages"),
    "coded": r"""SELECT *, nullif(regexp_extract(text,
        '(?im)^\s*(?:SERVICE CLASSIFICATION|S\.C\.)\s*(?:NO\.|NUMBER)\s*([0-9]+(?:-[A-Z]|[A-Z])?)', 1), '') AS raw FROM tariff_pages""",
    "carried": """SELECT doc_id, page_number, text, concat('SC', upper(replace(raw, '-', ''))) AS code, raw,
        last_value(CASE WHEN raw IS NOT NULL THEN concat('SC', upper(replace(raw, '-', ''))) END IGNORE NULLS)
        OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM coded""",
    "marked": """SELECT *, CASE WHEN raw IS NOT NULL AND code IS DISTINCT FROM before THEN page_number END AS begins FROM carried""",
    "sectioned": """SELECT doc_id, page_number, text, code,
        last_value(begins IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number) AS start_page FROM marked""",
    "named": """SELECT s.doc_id, s.page_number, s.text, s.start_page, f.code AS sc_code FROM sectioned s
        JOIN sectioned f ON f.doc_id = s.doc_id AND f.page_number = s.start_page""",
    "placed": """SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, start_page ORDER BY page_number
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM named""",
    "texts": """SELECT doc_id, sc_code, start_page, string_agg(text, chr(10) ORDER BY page_number) AS full_text,
        max(page_number) AS last_page, count(*) AS n_pages FROM named GROUP BY 1, 2, 3""",
}
ORACLE["f7_section_pages"] = _with(
    SECTIONS,
    'SELECT doc_id, sc_code, start_page, page_number, CAST(off AS BIGINT) AS "offset", md5(text) AS text FROM placed',
)
ORACLE["f8_recent_calls"] = _with(
    COSTS,
    """SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place, event_id, key, success
    FROM costs QUALIFY place <= 20""",
)
ORACLE["f9_bill_numbers"] = _with(
    BILL,
    "SELECT id, bill_account, row_number() OVER (PARTITION BY bill_account ORDER BY bill_date, id) AS bill_no FROM bills",
)

# ---- limits, sets and upserts

LEDGER = {
    **_views("run_events"),
    "ledger": """SELECT s.run_id, s.dag_id, strftime(s.ts, '%Y-%m-%d %H:%M:%S') AS start_time, s.ts AS started,
        strftime(f.ts, '%Y-%m-%d %H:%M:%S') AS end_time, coalesce(f.status, 'running') AS status, f.error_msg,
        CAST(floor((epoch_us(f.ts) - epoch_us(s.ts)) / 1000000) AS INTEGER) AS total_runtime
        FROM run_events s LEFT JOIN run_events f ON f.run_id = s.run_id AND f.kind = 'finish' WHERE s.kind = 'start'""",
}
_LEDGER_OUT = "run_id, dag_id, start_time, end_time, status, error_msg, total_runtime"
ORACLE["h1_recent_runs"] = _with(LEDGER, f"SELECT {_LEDGER_OUT} FROM ledger ORDER BY started DESC, run_id DESC LIMIT 20")
ORACLE["h3_first_lines"] = _with(
    LOGGED,
    """SELECT file AS log_file, count(*) AS n_lines, max(line_no) AS last_line FROM parsed WHERE line_no <= 5000 GROUP BY 1""",
)
ORACLE["h4_model_texts"] = _with(
    SECTIONS,
    """SELECT doc_id, sc_code, start_page, CAST(length(left(full_text, 25000)) AS INTEGER) AS n_chars, md5(left(full_text, 25000)) AS digest FROM texts""",
)
ORACLE["j1_parse_model_json"] = _with(
    WITH_LOGIC, f"SELECT doc_id, pos, sc_code, norm_code, {txt('effective_date')}, fee, logic FROM logics"
)
ORACLE["j1_unreadable_answers"] = _with(
    _views("tariff_answers"), "SELECT doc_id, answer FROM tariff_answers WHERE shape = 6"
)
ORACLE["k1_upsert_rates"] = _with(
    {
        **MONTHLY,
        "entered": """SELECT ['tra', 'rdm', 'sbc', 'ram'][s_suppkey % 4 + 1] AS rate_type,
            ['SC1', 'SC1C', 'SC2', 'SC2D', 'SC3', ' '][s_suppkey % 6 + 1] AS sc_code,
            make_date(1996 + s_suppkey % 7, 1 + s_suppkey % 12, 1) AS month,
            CAST(s_suppkey * CAST(0.0001 AS DECIMAL(4,4)) AS DECIMAL(18,6)) AS rate, s_suppkey AS seq FROM supplier WHERE s_suppkey % 11 <> 0""",
        "changes": """SELECT * FROM entered WHERE trim(sc_code) <> ''
            QUALIFY row_number() OVER (PARTITION BY rate_type, sc_code, month ORDER BY seq DESC) = 1""",
        "targets": """SELECT c.*, n.id AS target FROM changes c LEFT JOIN newest n ON n.rate_type = c.rate_type AND n.sc_code = c.sc_code AND n.month = c.month""",
    },
    """SELECT r.rate_type, r.id, CAST(CAST(coalesce(t.month, r.effective_date) AS DATE) AS VARCHAR) AS effective_date, r.sc_code,
    CAST(coalesce(t.rate, r.rate) AS DOUBLE) AS rate FROM adjustment_rates r LEFT JOIN targets t ON t.target = r.id AND t.rate_type = r.rate_type
    UNION ALL SELECT rate_type, NULL, CAST(month AS VARCHAR), sc_code, CAST(rate AS DOUBLE) FROM targets WHERE target IS NULL""",
)
ORACLE["k2_upsert_versions"] = _with(
    WITH_LOGIC,
    f"""SELECT doc_id AS document_id, sc_code, {txt('effective_date')}, logic FROM logics WHERE pos = 0
    QUALIFY row_number() OVER (PARTITION BY sc_code, effective_date ORDER BY doc_id DESC) = 1""",
)
ORACLE["k3_upsert_documents"] = _with(
    _views("raw_documents"),
    """SELECT file_name AS filename, concat('Utility ', source) AS utility_name, id AS upload_date, id AS document_version FROM raw_documents
    QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY id DESC) = 1""",
)
ORACLE["k4_update_status"] = _with(
    _views("raw_documents"),
    """SELECT id, file_name, CASE l.toxic WHEN 1 THEN 'error' WHEN 0 THEN 'processed' ELSE status END AS status
    FROM raw_documents LEFT JOIN labels l ON l.doc_id = id""",
)
ORACLE["k5_run_ledger"] = _with(LEDGER, f"SELECT {_LEDGER_OUT} FROM ledger")

# ---- text

ORACLE["l1_bill_rows"] = _with(
    BILL,
    f"""SELECT bill_account, customer, {txt('bill_date', 'read_date')}, days_used, billed_kwh, billed_demand, load_factor, billed_rkva,
    {dbl('bill_amount', 'sales_tax_amt')}, CAST(bill_amount + sales_tax_amt AS DOUBLE) AS bill_amount_with_sales_tax,
    CAST(id % 100 AS DOUBLE) AS retracted_amt, CASE WHEN id % 2 = 0 THEN 0.08E0 END AS sales_tax_factor FROM bills""",
)
ORACLE["l2_tariff_sections"] = _with(
    {
        **SECTIONS,
        "spanned": "SELECT *, lead(start_page) OVER (PARTITION BY doc_id ORDER BY start_page) AS nxt FROM texts",
        "lasting": "SELECT * FROM spanned QUALIFY row_number() OVER (PARTITION BY doc_id, sc_code ORDER BY start_page DESC) = 1",
        "dated": r"SELECT *, regexp_extract(full_text, '(?i)Effective Date:\s*(\d{2}/\d{2}/\d{4})', 1) AS d FROM lasting",
    },
    """SELECT doc_id, sc_code, start_page, coalesce(nxt - 1, last_page) AS end_page,
    CASE WHEN d = '' THEN '2025-09-01' ELSE strftime(strptime(d, '%m/%d/%Y'), '%Y-%m-%d') END AS effective_date, n_pages,
    length(full_text) AS n_chars, full_text FROM dated""",
)
_SQUASH = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
ORACLE["n1_names"] = rf"""SELECT doc_id, md5(regexp_replace(upper(replace({_SQUASH}, 'ß', 'ss')), '[^A-Z0-9 &''.,\-/]', '', 'g')) AS caps,
    CASE WHEN sheet = '' THEN 'Results' ELSE sheet END AS sheet, CAST(length({_SQUASH}) AS INTEGER) AS n_chars
    FROM (SELECT *, left(trim(regexp_replace(regexp_replace(text, '[:\\/?*\[\]]', ' ', 'g'), '\s+', ' ', 'g')), 31) AS sheet FROM documents)"""
ORACLE["n2_token_kinds"] = _with(
    {
        **BILL,
        "tokens": """SELECT id, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS no, unnest([strftime(read_date, '%-m/%-d/%Y'), CAST(bill_amount AS VARCHAR),
            concat('$', format('{:,.2f}', CAST(bill_amount AS DOUBLE))), format('{:,}', CAST(billed_kwh AS BIGINT)), CAST(load_factor AS VARCHAR),
            bill_account, customer, concat('Page ', CAST(days_used AS VARCHAR), ' of 40')]) AS token FROM bills""",
    },
    r"""SELECT id, no, regexp_full_match(token, '\d{1,2}/\d{1,2}/\d{2,4}') AS is_date, regexp_full_match(token, '-?[\d,]+') AS is_int,
    regexp_full_match(replace(token, ',', ''), '-?\d*\.?\d+') AS is_num, regexp_full_match(token, '\$?-?[\d,]*\.?\d+') AS is_money,
    token LIKE 'Page%' AS is_footer FROM tokens""",
)
ORACLE["n3_number_formats"] = _with(
    BILL,
    r"""SELECT id, concat('$', format('{:,.2f}', CAST(bill_amount AS DOUBLE))) AS money, format('{:,}', CAST(billed_kwh AS BIGINT)) AS whole,
    regexp_replace(CAST(bill_amount AS VARCHAR), '\.?0+$', '') AS trimmed FROM bills""",
)
ORACLE["n4_repair_scan"] = _with(
    BILL,
    """SELECT id, repaired, concat(repaired, ' ', strftime(read_date, '%m/%d/%Y')) AS parted
    FROM (SELECT *, strftime(read_date, '%-m/%d/%Y') AS repaired FROM bills)""",
)
ORACLE["n6_effective_date"] = _with(
    _views("tariff_pages"),
    """SELECT doc_id, page_number, CASE WHEN page_number % 3 = 1 THEN concat('1999-0', CAST(1 + doc_id % 9 AS VARCHAR), '-15') END AS printed,
    CAST(make_date(CAST(1990 + doc_id % 30 AS INTEGER), CAST(1 + page_number % 12 AS INTEGER), 9) AS VARCHAR) AS worded FROM tariff_pages""",
)

# ---- streams (final state)

ORACLE["s1_stream_usage"] = _with(
    COSTS,
    """SELECT month, key AS model, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
    CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens,
    CAST(sum(cost) AS DOUBLE) AS cost FROM costs WHERE kind = 'llm' GROUP BY month, key""",
)
ORACLE["s1_stream_operations"] = _with(
    COSTS,
    """SELECT month, key AS operation, count(*) AS requests, count(*) FILTER (success) AS success,
    count(*) FILTER (NOT success) AS failures FROM costs WHERE kind = 'op' GROUP BY month, key""",
)
ORACLE["s2_stream_logs"] = _with(
    LOGGED,
    """SELECT 'app' AS source, CASE WHEN fits THEN trim(split_part(line, '|', 2)) ELSE 'INFO' END AS level,
    CASE WHEN fits THEN concat(left(line, 13), ':00:00') END AS hour, count(*) AS n_lines FROM parsed GROUP BY ALL""",
)

# ---- stored tables

ORACLE["g3_incremental"] = _with(
    {**ANOMALIES, "ranked": "SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM bills"},
    f"""SELECT n * 9 + rule AS id, account AS account_id, n AS user_bill_id, rule_id AS issue_type, {RULE_TEXT} AS description, status
    FROM found JOIN ranked ON bill_id = id""",
)
for _stored, _pure in (
    ("k1_stored_rates", "k1_upsert_rates"), ("k2_stored_versions", "k2_upsert_versions"), ("k3_stored_documents", "k3_upsert_documents"),
    ("k4_stored_status", "k4_update_status"), ("k5_stored_runs", "k5_run_ledger"),
):
    ORACLE[_stored] = ORACLE[_pure]

ORACLE["s2_log_files"] = _with(
    {
        **LOGGED,
        "lines": """SELECT CASE WHEN fits THEN trim(split_part(line, '|', 2)) ELSE 'INFO' END AS level, line_no % 50 = 0 AS again,
            CASE WHEN fits THEN CAST(left(line, 19) AS TIMESTAMP) END AS logged FROM parsed""",
        "counts": "SELECT level, date_trunc('hour', logged) AS start, count(*) AS n, count(*) FILTER (again) AS n_again FROM lines GROUP BY ALL",
        "closed": """SELECT *, coalesce(start + INTERVAL 1 HOUR <= (SELECT max(logged) - INTERVAL 2 HOUR FROM lines), false) AS is_final FROM counts""",
    },
    """SELECT 'app' AS source, level, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, n + CASE WHEN is_final THEN 0 ELSE n_again END AS n_lines,
    CASE WHEN is_final THEN n_again ELSE 0 END AS n_late, is_final FROM closed""",
)

# ---- filters of other results

ORACLE["c1_bill_results"] = ORACLE["d8_issues_of_bills"]
ORACLE["d1_account_issues"] = f"SELECT * FROM ({ORACLE['d1_bills_with_issues']}) WHERE {ACCOUNT} AND issue_type = 'R2_BILL_DAYS_OUT_OF_RANGE'"
ORACLE["d4_class_grid"] = f"SELECT * FROM ({ORACLE['d4_override_grid']}) WHERE service_class = 'SC1C'"
ORACLE["l2_model_inputs"] = f"""SELECT doc_id, sc_code, start_page, end_page, effective_date, md5(left(full_text, 25000)) AS digest
    FROM ({ORACLE['l2_tariff_sections']})"""
