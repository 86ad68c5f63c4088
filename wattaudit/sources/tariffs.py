"""Tariff documents: JSON definitions, model answers and page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattaudit.functions.tiers import STEP_RATE, tiers_of
from wattaudit.functions.values import norm_sc, parse_date

ITEMS = "array<variant>"


def _field(v: Column | str, name: str, to: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{name}", to)


def tariff_items(document: Column) -> Column:
    """Parsed document as an array of tariff objects: ``{"tariffs": […]}``, a bare list, or one object."""
    return F.coalesce(
        F.try_variant_get(document, "$.tariffs", ITEMS),
        F.try_variant_get(document, "$", ITEMS),
        F.when(document.isNotNull(), F.array(document)),
    )


def parse_step(step: Column, value: Column) -> Column:
    """Step object as a struct. Its value is a number, a map of voltage tiers, or prose (``bad_value``).

    ``value`` is the same value as JSON text, in which the tiers stand in their order; a variant sorts its keys.
    """
    number = F.coalesce(_field(step, "value", STEP_RATE), F.trim(_field(step, "value")).try_cast(STEP_RATE))
    tiers = F.from_json(value, "map<string,string>")
    return F.struct(
        F.coalesce(_field(step, "step_name"), F.lit("Step")).alias("step_name"),
        F.trim(F.coalesce(_field(step, "charge_type"), F.lit(""))).alias("charge_type"),
        number.alias("number"),
        F.when(number.isNull(), tiers_of(tiers)).alias("tiers"),
        (number.isNull() & (F.coalesce(_field(step, "value"), F.lit("")) != "")).alias("bad_value"),
        _field(step, "condition").alias("condition"),
        _field(step, "python_formula").alias("formula"),
    )


def item_date(item: Column) -> Column:
    """Effective date of a tariff object: at the top level, else under ``metadata``."""
    top = F.nullif(_field(item, "effective_date"), F.lit(""))
    return parse_date(F.coalesce(top, F.try_variant_get(item, "$.metadata.effective_date", "string")))


def explode_items(docs: DataFrame, body: str = "body", doc_id: str = "doc_id") -> DataFrame:
    """One row per tariff object: doc_id, pos, item (variant)."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.posexplode(tariff_items(F.try_parse_json(F.col(body)))).alias("pos", "item")
    )


_VALUES = "struct<logic_steps:array<struct<value:string>>>"


def _step_values(body: Column) -> Column:
    """Per tariff object of a document the values of its steps as JSON text."""
    one = F.from_json(body, _VALUES)
    return F.coalesce(
        F.from_json(body, f"tariffs array<{_VALUES}>")["tariffs"], F.from_json(body, f"array<{_VALUES}>"), F.when(one.isNotNull(), F.array(one))
    )


def tariff_versions(docs: DataFrame, body: str = "body", doc_id: str = "doc_id") -> DataFrame:
    """Tariff versions of JSON documents: sc_code, norm_code, effective_date, steps, and where each came from."""
    items = docs.select(
        F.col(doc_id).alias("doc_id"), _step_values(F.col(body)).alias("_values"),
        F.posexplode(tariff_items(F.try_parse_json(F.col(body)))).alias("pos", "item"),
    )
    found = F.coalesce(_field("item", "logic_steps", ITEMS), F.array().cast(ITEMS))
    values = F.get("_values", F.col("pos"))["logic_steps"]
    steps = F.transform(found, lambda step, i: parse_step(step, F.get(values, i)["value"]))
    return items.select(
        "doc_id",
        "pos",
        _field("item", "sc_code").alias("sc_code"),
        norm_sc(_field("item", "sc_code")).alias("norm_code"),
        item_date(F.col("item")).alias("effective_date"),
        steps.alias("steps"),
    )


def parse_model_json(answers: DataFrame, text: str = "answer", keys: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """Tariff objects in model answers, and the answers that hold none.

    An answer may be bare JSON, JSON in a code fence, or JSON within prose (from the first ``{`` to the last ``}``).
    """
    # Arrays of one value are unfolded, as in ``billtext.with_clean_text``: the answer, its document and its objects are each made once.
    answers, raw = answers.withColumn(text, F.explode(F.array(text))), F.col(text)
    fenced = F.regexp_extract(raw, r"(?s)```json(.*?)(?:```|$)", 1)
    plain = F.regexp_extract(raw, r"(?s)```(.*?)(?:```|$)", 1)
    body = F.trim(F.when(raw.contains("```json"), fenced).when(raw.contains("```"), plain).otherwise(raw))
    braces = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    parsed = answers.withColumn("_doc", F.explode(F.array(F.coalesce(F.try_parse_json(body), F.try_parse_json(braces)))))
    items = parsed.where(F.col("_doc").isNotNull()).select(*keys, F.explode(F.array(tariff_items(F.col("_doc")))).alias("_items"))
    good = items.select(*keys, F.posexplode("_items").alias("pos", "item"))
    bad = parsed.where(F.col("_doc").isNull()).select(*keys, text)
    return good, bad


_PAGE = "struct<page_number:int,text:string,tables:array<array<array<string>>>>"


def doc_pages(docs: DataFrame, body: str = "body", doc_id: str = "doc_id") -> DataFrame:
    """Pages of page-text JSON in either layout: ``{"pages": […]}`` or ``{"<n>": {"text": …}}`` (other keys → page 0)."""
    listed = F.from_json(body, f"pages array<{_PAGE}>")["pages"]
    by_number = F.map_entries(F.from_json(body, "map<string,struct<text:string,tables:array<array<array<string>>>>>"))
    keyed = F.transform(
        F.filter(by_number, lambda e: e["value"]["text"].isNotNull()),
        lambda e: F.struct(
            F.when(e["key"].rlike(r"^\d+$"), e["key"].try_cast("int")).otherwise(0).alias("page_number"),
            e["value"]["text"].alias("text"),
            e["value"]["tables"].alias("tables"),
        ),
    )
    pages = F.when(F.size(F.coalesce(listed, F.array().cast(f"array<{_PAGE}>"))) > 0, listed).otherwise(keyed)
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(pages).alias("p")).select(
        "doc_id",
        F.coalesce("p.page_number", F.lit(0)).alias("page_number"),
        F.coalesce("p.text", F.lit("")).alias("text"),
        "p.tables",
    )
