"""Tariff sections: which class each page of a tariff document belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattaudit.functions.text import effective_date

# Heading of a section, the windows of the original in which it and its date are looked for, and the default date.
HEADING = r"^\s*(?:SERVICE CLASSIFICATION|S\.C\.)\s*(?:NO\.|NUMBER)\s*([0-9]+(?:-[A-Z]|[A-Z])?)"
HEADING_CHARS = 1_000
DATE_CHARS = 3_000
MODEL_CHARS = 25_000
DEFAULT_DATE = "2025-09-01"

SECTION = ["doc_id", "sc_code", "start_page"]


def heading_code(text: Column, chars: int | None = None) -> Column:
    """Class code of the first section heading of a page (within its first ``chars`` characters), null if there is none."""
    raw = F.regexp_extract(text if chars is None else F.substring(text, 1, chars), f"(?imd){HEADING}", 1)
    return F.when(raw != "", F.concat(F.lit("SC"), F.upper(F.translate(raw, "- ", ""))))


def _block_states(pages: DataFrame, width: int, heading_chars: int | None) -> DataFrame:
    """Per block of ``width`` page numbers what its first page begins with: (doc_id, block, code, start_page, used).

    Texts stay behind: a page is its number, the class of its heading and its length. The pages of a block are folded into one state: the
    first heading and its page, the characters before it and in its run, and the section that is open at the end if a later heading changes the
    class. Only whether the first heading begins a section depends on earlier blocks, which one pass over the blocks tells.
    """
    size = F.length("text") + 1
    page = F.struct("page_number", F.xxhash64("text").alias("tie"), heading_code(F.col("text"), heading_chars).alias("code"), size.alias("size"))
    folded = pages.groupBy("doc_id", _block(width).alias("block")).agg(F.array_sort(F.collect_list(page)).alias("pages"))
    text, whole, count = (F.lit(None).cast(t) for t in ("string", "int", "long"))
    zero = F.lit(0).cast("long")
    number = whole.cast(pages.schema["page_number"].dataType)
    empty = F.struct(
        text.alias("first"), number.alias("first_page"), zero.alias("before"), zero.alias("run"), F.lit(False).alias("changed"), text.alias("code"),
        number.alias("start"), zero.alias("used"),
    )

    def step(s: Column, p: Column) -> Column:
        code, length = p["code"], p["size"].cast("long")
        opens = s["first"].isNull() & code.isNotNull()
        waits = s["first"].isNull() & code.isNull()
        turns = s["first"].isNotNull() & code.isNotNull() & (code != s["code"])
        changed = s["changed"] | turns
        return F.struct(
            F.when(opens, code).otherwise(s["first"]).alias("first"),
            F.when(opens, p["page_number"]).otherwise(s["first_page"]).alias("first_page"),
            (s["before"] + F.when(waits, length).otherwise(zero)).alias("before"),
            (s["run"] + F.when(waits | changed, zero).otherwise(length)).alias("run"),
            changed.alias("changed"),
            F.when(opens | turns, code).otherwise(s["code"]).alias("code"),
            F.when(turns, p["page_number"]).otherwise(s["start"]).alias("start"),
            F.when(turns, length).when(s["changed"], s["used"] + length).otherwise(zero).alias("used"),
        )

    size_of = F.aggregate("pages", zero, lambda total, p: total + p["size"])
    blocks = folded.select("doc_id", "block", F.aggregate("pages", empty, step).alias("s"), size_of.alias("size"))
    earlier = W.partitionBy("doc_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumns({"_code": F.last("s.code", ignorenulls=True).over(earlier), "_at": F.coalesce(F.sum("size").over(earlier), zero)})
    begins = F.col("s.first").isNotNull() & ~F.col("s.first").eqNullSafe(F.col("_code"))
    opened = F.when(F.col("s.changed"), F.struct(F.col("s.start").alias("page"), (F.col("_at") + F.col("size") - F.col("s.used")).alias("at"))).when(
        begins, F.struct(F.col("s.first_page").alias("page"), (F.col("_at") + F.col("s.before")).alias("at"))
    )
    # Where the open section began, in characters of the document.
    open_ = F.last(opened, ignorenulls=True).over(earlier)
    return blocks.select("doc_id", "block", F.col("_code").alias("code"), open_.alias("o"), "_at").select(
        "doc_id", "block", "code", F.col("o.page").alias("start_page"), (F.col("_at") - F.col("o.at")).alias("used")
    )


def _block(width: int) -> Column:
    return F.expr(f"page_number div {width}")


def section_pages(pages: DataFrame, width: int = 10_000, heading_chars: int | None = None) -> DataFrame:
    """Pages with the section they belong to: sc_code, start_page, and ``offset``, the place of the page's text in the
    section's text (pages joined by line breaks).

    A heading starts a section when its class differs from that of the heading before. Pages before any heading belong to
    none. Pages of one number are in order of a hash of their texts.

    Two scans and one shuffle of the texts: the first scan leaves one row per block, and in the second one the pages of a block go on from it.
    """
    carried = _block_states(pages, width, heading_chars).withColumnsRenamed({"doc_id": "_doc", "block": "_number", "code": "_open_code", "start_page": "_open_page"})
    found = pages.withColumns({"_block": _block(width), "_code": heading_code(F.col("text"), heading_chars), "_tie": F.xxhash64("text")})
    found = found.join(carried, found["doc_id"].eqNullSafe(carried["_doc"]) & (found["_block"] == carried["_number"]))
    order = W.partitionBy("doc_id", "_block").orderBy("page_number", "_tie")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    found = found.withColumns(
        {
            "_before": F.coalesce(F.last("_code", ignorenulls=True).over(before), "_open_code"),
            "_at": F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0).cast("long")),
        }
    )
    starts = F.col("_code").isNotNull() & ~F.col("_code").eqNullSafe(F.col("_before"))
    begun = F.when(starts, F.struct(F.col("page_number").alias("page"), F.col("_at").alias("at")))
    found = found.withColumn("_begun", F.last(begun, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    start = F.coalesce("_begun.page", "_open_page")
    offset = F.when(F.col("_begun").isNotNull(), F.col("_at") - F.col("_begun.at")).otherwise(F.col("used") + F.col("_at"))
    return found.where(start.isNotNull()).select(
        "doc_id", "page_number", "text", start.alias("start_page"), F.coalesce("_code", "_before").alias("sc_code"), offset.alias("offset")
    )


def _joined(chars: int | None) -> Column:
    """The texts of a section in order of their pages, or their first ``chars`` characters."""
    part = F.struct("page_number", "offset", "text")
    if chars is not None:
        # A page that begins right behind the range still decides whether the range ends in a line break.
        cut = F.substring("text", F.lit(1), (F.lit(chars) - F.col("offset")).cast("int"))
        part = F.when(F.col("offset") <= chars, F.struct("page_number", "offset", cut.alias("text")))
    texts = F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"])
    joined = F.array_join(texts, "\n")
    return joined if chars is None else F.left(joined, F.lit(chars))


def section_text(pages: DataFrame, chars: int | None) -> DataFrame:
    """First ``chars`` characters of each section's text (None: all of it), as ``text``.

    Only pages that begin within the range are gathered, so with a limit a section gathers at most that many characters.
    A whole section is one value by nature; rows of ``section_pages`` hold the same text without gathering it.
    """
    return pages.groupBy(*SECTION).agg(_joined(chars).alias("text"))


def tariff_sections(
    pages: DataFrame,
    width: int = 10_000,
    full_text: bool = True,
    default_date: str = DEFAULT_DATE,
    heading_chars: int | None = None,
    date_chars: int | None = None,
) -> DataFrame:
    """One row per document and class: start_page, end_page, effective_date, n_pages, n_chars (and ``full_text``).

    Where a class comes back later in a document, only its last section counts; ``end_page`` is the page before the next section.
    Headings and dates are looked for in whole pages and sections; ``heading_chars`` and ``date_chars`` limit that to
    the beginning, as the original does with HEADING_CHARS and DATE_CHARS.
    """
    placed = section_pages(pages, width, heading_chars)
    # Pages and texts of a section are gathered together, so the pages are placed once.
    spans = placed.groupBy(*SECTION).agg(
        F.max("page_number").alias("last_page"),
        F.count(F.lit(1)).alias("n_pages"),
        (F.sum(F.length("text") + 1) - 1).alias("n_chars"),
        _joined(None if full_text else date_chars).alias("text"),
    )
    after = F.lead("start_page").over(W.partitionBy("doc_id").orderBy("start_page"))
    last = F.row_number().over(W.partitionBy("doc_id", "sc_code").orderBy(F.desc("start_page")))
    sections = spans.withColumn("end_page", F.coalesce(after - 1, F.col("last_page"))).withColumn("_last", last).where("_last = 1")
    searched = F.col("text") if date_chars is None else F.left(F.col("text"), F.lit(date_chars))
    date = F.coalesce(effective_date(searched), F.to_date(F.lit(default_date)))
    out = ["doc_id", "sc_code", "start_page", "end_page", "effective_date", "n_pages", "n_chars"]
    found = sections.withColumn("effective_date", date)
    return found.select(*out, *([F.col("text").alias("full_text")] if full_text else []))


def attach_tables(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """Pages with their tables, one row per table (``table`` null for a page without any)."""
    key = ["doc_id", "page_number"]
    filled = tables.join(pages, key).select(*key, "text", "table")
    bare = pages.join(tables.select(*key).distinct(), key, "left_anti")
    return filled.unionByName(bare.select(*key, "text", F.lit(None).cast(filled.schema["table"].dataType).alias("table")))
