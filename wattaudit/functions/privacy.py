"""De-identification: keyed account tokens, allow-list payloads and a leak check."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys that must never appear in a payload.
FORBIDDEN_FIELDS = ("customer_name", "service_address", "account_number", "meter_number")

_BLOCK = 64


def tokenize(c: Column | str, prefix: str, key: str) -> Column:
    """``PREFIX_`` + first 12 hex digits of HMAC-SHA256(key, trimmed value); null or '' → ``PREFIX_UNKNOWN``.

    The two padded keys are literals, so the token is two built-in ``sha2`` calls per row.
    """
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > _BLOCK else raw).ljust(_BLOCK, b"\0")
    inner_pad = F.unhex(F.lit(bytes(b ^ 0x36 for b in raw).hex()))
    outer_pad = F.unhex(F.lit(bytes(b ^ 0x5C for b in raw).hex()))
    value = F.col(c) if isinstance(c, str) else c
    inner = F.unhex(F.sha2(F.concat(inner_pad, F.encode(F.trim(value), "UTF-8")), 256))
    digest = F.sha2(F.concat(outer_pad, inner), 256)
    token = F.concat(F.lit(f"{prefix}_"), F.substring(digest, 1, 12))
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(f"{prefix}_UNKNOWN")).otherwise(token)


def safe_payload(
    bills: DataFrame,
    key: str,
    rate_schedule: str = "service_class",
    start: Column | None = None,
    end: str = "read_date",
    charges: Column | None = None,
    total: str = "bill_amount",
    zip_code: str | None = None,
    meter: str | None = None,
    include_zip: bool = True,
) -> DataFrame:
    """One JSON ``payload`` per bill holding only the allowed fields; the account and the meter appear as tokens.

    ``zip_code`` is added only when present and wanted, ``meter_token`` only when the bill names a meter.
    """
    no_charges = F.array().cast("array<struct<description:string,amount:double,rate_code:string>>")
    always = F.struct(
        tokenize("bill_account", "ACCT", key).alias("account_token"),
        F.col(rate_schedule).alias("rate_schedule"),
        F.struct(
            (F.lit(None).cast("date") if start is None else start).alias("start"), F.col(end).alias("end")
        ).alias("billing_period"),
        F.col("billed_kwh").alias("usage_kwh"),
        F.col("billed_demand").alias("demand_kw"),
        (no_charges if charges is None else F.coalesce(charges, no_charges)).alias("charges"),
        F.col(total).alias("total_due"),
    )
    payload = F.to_json(always, {"ignoreNullFields": "false"})
    optional = []
    if zip_code and include_zip:
        optional.append(F.nullif(F.col(zip_code), F.lit("")).alias("zip_code"))
    if meter:
        named = F.coalesce(F.col(meter), F.lit("")) != ""
        optional.append(F.when(named, tokenize(meter, "METER", key)).alias("meter_token"))
    if optional:
        extra = F.to_json(F.struct(*optional), {"ignoreNullFields": "true"})
        joined = F.concat(F.left(payload, F.length(payload) - 1), F.lit(","), F.right(extra, F.length(extra) - 1))
        payload = F.when(extra == "{}", payload).otherwise(joined)
    return bills.select("id", payload.alias("payload"))


def leaked_fields(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Payload rows with a forbidden key, and which."""
    found = F.array_intersect(
        F.json_object_keys(F.col(payload)), F.array(*[F.lit(f) for f in FORBIDDEN_FIELDS])
    )
    return payloads.withColumn("leaked", F.array_sort(found)).where(F.size("leaked") > 0)


def assert_no_pii(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """The same rows; the job fails on the first payload that holds a forbidden key, and at once on such a column."""
    named = sorted(set(FORBIDDEN_FIELDS) & set(payloads.columns))
    if named:
        raise ValueError(f"forbidden columns: {named}")
    found = F.array_intersect(
        F.json_object_keys(F.col(payload)), F.array(*[F.lit(f) for f in FORBIDDEN_FIELDS])
    )
    checked = F.when(F.size(found) > 0, F.raise_error(F.concat(F.lit("forbidden fields: "), F.array_join(found, ", "))))
    return payloads.withColumn(payload, F.coalesce(checked.cast("string"), F.col(payload)))
