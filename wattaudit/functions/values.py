"""Cleaning of single values: numbers, dates, codes, flags and number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Customer names that mark a municipal account (substring match on the upper-cased name).
MUNICIPAL_WORDS = (
    "CITY",
    "TOWN",
    "VILLAGE",
    "COUNTY",
    "CITY OF",
    "TOWN OF",
    "VILLAGE OF",
    "SCHOOL",
    "UNIVERSITY",
    "STATE OF",
    "DEPT",
    "DEPARTMENT",
    "MUNICIPAL",
)

# Service-class labels of the user interface and the code each stands for.
CLASS_LABELS = {
    "SC-1": "SC1",
    "SC-1C": "SC1C",
    "SC-2 ND": "SC2",
    "SC-2": "SC2D",
    "SC-3": "SC3",
    "SC-3A": "SC3A",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_number(c: Column | str, on_bad: str = "null", to: str = "double") -> Column:
    """Number from text such as ``$1,234.56``; what cannot be read becomes null (ingest) or 0 (audit)."""
    if on_bad not in ("null", "zero"):
        raise ValueError("on_bad is 'null' or 'zero'")
    value = F.trim(F.translate(_col(c).cast("string"), "$,", "")).try_cast(to)
    if to in ("double", "float"):
        value = F.when(~F.isnan(value), value)
    return F.coalesce(value, F.lit(0).cast(to)) if on_bad == "zero" else value


def clean_int(c: Column | str) -> Column:
    """Whole number from text; fractions are cut off."""
    return clean_number(c).try_cast("int")


def _short_year(text: Column, pattern: str) -> Column:
    """Two-digit years: 69-99 are 19xx, 00-68 are 20xx."""
    parsed = F.try_to_timestamp(text, F.lit(pattern)).cast("date")
    return F.when(F.year(parsed) > 2068, F.add_months(parsed, -1200)).otherwise(parsed)


def parse_date(c: Column | str) -> Column:
    """Date from ``M/d/yyyy``, ``M/d/yy``, ``yyyy-M-d``, ``yyyy/M/d``, ``Jan 5, 2021`` or ``5-Jan-21`` (month names in full
    or short, years of two or four digits), else any form Spark can cast; bad → null."""
    text = F.trim(_col(c).cast("string"))
    return (
        F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(text, F.lit("M/d/yyyy")).cast("date"))
        .when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), _short_year(text, "M/d/yy"))
        .when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(text, F.lit("yyyy-M-d")).cast("date"))
        .when(text.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_timestamp(text, F.lit("yyyy/M/d")).cast("date"))
        .when(text.rlike(_MONTH_FIRST), _named_month(text, _MONTH_FIRST, (1, 2, 3)))
        .when(text.rlike(_DAY_FIRST), _named_month(text, _DAY_FIRST, (2, 1, 3)))
        .otherwise(text.try_cast("date"))
    )


_MONTH_FIRST = r"^([A-Za-z]{3,9})\.?\s+(\d{1,2})\s*,?\s+(\d{4}|\d{2})$"
_DAY_FIRST = r"^(\d{1,2})[\s-]([A-Za-z]{3,9})\.?[\s,-]+(\d{4}|\d{2})$"


def _named_month(text: Column, pattern: str, groups: tuple[int, int, int]) -> Column:
    """Date from the groups of month, day and year; a name counts by its first three letters if it begins a month's name."""
    month, day, year = (F.regexp_extract(text, pattern, g) for g in groups)
    short = F.initcap(F.left(month, F.lit(3)))
    plain = F.concat_ws(" ", short, day, year)
    full = F.date_format(F.try_to_timestamp(plain, F.lit("MMM d yyyy")), "MMMM")
    dated = F.when(F.length(year) == 4, F.try_to_timestamp(plain, F.lit("MMM d yyyy")).cast("date"))
    dated = dated.otherwise(_short_year(plain, "MMM d yy"))
    two = F.date_format(F.try_to_timestamp(plain, F.lit("MMM d yy")), "MMMM")
    return F.when(F.startswith(F.lower(F.coalesce(full, two)), F.lower(month)), dated)


def norm_sc(c: Column | str) -> Column:
    """Service-class code: null → '', upper case, without blanks and dashes."""
    return F.upper(F.translate(F.coalesce(_col(c), F.lit("")), " -", ""))


def class_of_label(c: Column | str) -> Column:
    """Code of a display label; anything else is normalised as a code."""
    label = _col(c)
    code = F.when(F.lit(False), F.lit(None).cast("string"))
    for text, value in CLASS_LABELS.items():
        code = code.when(label == text, value)
    return code.otherwise(norm_sc(label))


def month_start(c: Column | str) -> Column:
    return F.trunc(_col(c).cast("date"), "month")


def is_municipality(c: Column | str) -> Column:
    """True if the customer name contains one of the municipal words; null or '' → false."""
    name = F.upper(_col(c))
    return F.coalesce(name.rlike("|".join(MUNICIPAL_WORDS)), F.lit(False))


def money(c: Column | str) -> Column:
    """Decimal with two places, halves away from zero."""
    return _col(c).cast("decimal(18,2)")


def money_text(c: Column | str) -> Column:
    """``$1,234.50``"""
    return F.concat(F.lit("$"), F.format_number(money(c), 2))


def int_text(c: Column | str) -> Column:
    """Digits with thousands separators; text without digits → ''."""
    digits = F.regexp_replace(_col(c).cast("string"), r"[^\d\-]", "")
    return F.when(digits.isin("", "-"), "").otherwise(F.format_number(digits.try_cast("bigint"), 0))


def trimmed_decimal(c: Column | str, places: int) -> Column:
    """Fixed number of decimals with trailing zeros (and point) removed; unreadable text stays as it is."""
    text = _col(c).cast("string")
    value = F.translate(text, ",", "").try_cast("double")
    fixed = F.format_string(f"%.{places}f", value)
    trimmed = F.regexp_replace(fixed, r"\.?0+$", "") if places else fixed
    return F.when(value.isNull(), text).otherwise(trimmed)


def finite(c: Column | str) -> Column:
    """NaN and infinities → null."""
    v = _col(c)
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)
