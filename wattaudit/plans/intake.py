"""From documents to tables: the two ingest flows as one lazy plan each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattaudit.operators.anomalies import detect_anomalies, validation_rows
from wattaudit.operators.billtext import bill_rows
from wattaudit.operators.sections import MODEL_CHARS, tariff_sections
from wattaudit.operators.versions import code_mismatch, stored_logic, upsert_versions
from wattaudit.schemas import TARIFF_VERSIONS
from wattaudit.sources.bills import append_bills
from wattaudit.sources.tariffs import doc_pages, item_date, parse_model_json


@dataclass
class BillIntake:
    bills: DataFrame
    issues: DataFrame


def bill_intake(docs: DataFrame, target: str, first_id: int = 0, detected_on: Column | None = None) -> BillIntake:
    """Documents (doc_id, text) → stored bills → validation results.

    The bills are written first: their ids and the findings about them then come from the same stored rows, whatever
    happens to an executor. All bills of the table are validated, so older bills serve as history.
    """
    append_bills(bill_rows(docs), target, first_id)
    bills = docs.sparkSession.read.parquet(target)
    when = F.current_timestamp() if detected_on is None else detected_on
    return BillIntake(bills, validation_rows(detect_anomalies(bills), when))


def model_inputs(docs: DataFrame) -> DataFrame:
    """Page-text documents → one text per tariff section for the extraction model: doc_id, sc_code, date, text.

    The model reads at most ``MODEL_CHARS`` characters of a section.
    """
    found = tariff_sections(doc_pages(docs))
    return found.withColumn("text", F.left("full_text", F.lit(MODEL_CHARS)))


@dataclass
class TariffIntake:
    register: DataFrame
    mismatched: DataFrame
    unreadable: DataFrame


def tariff_intake(answers: DataFrame, register: DataFrame) -> TariffIntake:
    """Model answers (doc_id, section_code, effective_date, answer) → the register of tariff versions.

    A tariff takes the date of its section. Tariffs of another class than their section are reported, and kept;
    answers without JSON are set aside.
    """
    items, bad = parse_model_json(answers, "answer", ("doc_id", "section_code", "effective_date"))
    found = items.select(
        "doc_id",
        "section_code",
        F.coalesce("effective_date", item_date(F.col("item"))).alias("effective_date"),
        F.try_variant_get("item", "$.sc_code", "string").alias("sc_code"),
        stored_logic(F.col("item")).alias("logic"),
        F.struct("doc_id", "pos").alias("seq"),
    )
    changes = found.where(F.col("sc_code").isNotNull() & F.col("effective_date").isNotNull()).select(
        F.col("doc_id").alias("document_id"), "sc_code", "effective_date", "logic", "seq"
    )
    register = register.select(*TARIFF_VERSIONS.fieldNames())
    return TariffIntake(upsert_versions(register, changes), code_mismatch(found), bad)
