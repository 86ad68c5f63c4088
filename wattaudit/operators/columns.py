"""Column sets: aliases, required columns, target schemas and null-safe output."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattaudit.functions.text import clean_columns
from wattaudit.functions.values import clean_number, finite, parse_date

# Column names accepted for each role of a bill, best first.
BILL_ROLES = {
    "bill_date": ("read_date", "bill_date", "date"),
    "billed_kwh": ("billed_kwh", "kwh", "usage_kwh", "energy_kwh"),
    "billed_demand": ("billed_demand", "demand_kw", "kw_demand"),
    "bill_amount": ("bill_amount", "total_bill", "current_charges", "amount_due"),
}
CLASS_NAMES = ("service_class", "rate_class", "sc_code", "serviceclassification", "service_classification")


def pick_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    return next((c for c in candidates if c in columns), None)


def resolve_columns(df: DataFrame, roles: Mapping[str, Sequence[str]] = BILL_ROLES) -> dict[str, str] | None:
    """Present column for each role; None if a role has none."""
    found = {role: pick_column(df.columns, names) for role, names in roles.items()}
    return None if None in found.values() else found


def as_bill_grid(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame | None:
    """Rows under the role names plus ``service_class`` (null if no such column); None if a role is missing."""
    df = clean_columns(df)
    found = resolve_columns(df)
    if found is None:
        return None
    sc = pick_column(df.columns, CLASS_NAMES)
    return df.select(
        *keep,
        *[F.col(source).alias(role) for role, source in found.items()],
        (F.col(sc) if sc else F.lit(None).cast("string")).alias("service_class"),
    )


def as_number(df: DataFrame, name: str, to: str = "double", on_bad: str = "null") -> Column:
    """Column as a number: text is cleaned, a numeric column is only cast."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return clean_number(name, on_bad, to)
    kind = df.schema[name].dataType
    value = finite(name) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(name)
    value = value.try_cast(to)
    return F.coalesce(value, F.lit(0).cast(to)) if on_bad == "zero" else value


def as_date(df: DataFrame, name: str) -> Column:
    """Column as a date: text is parsed, a date or time is only cast."""
    return parse_date(name) if isinstance(df.schema[name].dataType, T.StringType) else F.col(name).cast("date")


def conform_names(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in renames.items() if a in df.columns})


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def conform(
    df: DataFrame,
    schema: T.StructType,
    renames: Mapping[str, str] | None = None,
    defaults: Mapping[str, object] | None = None,
    required: Sequence[str] = (),
    casts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``df`` with exactly the columns of ``schema``, in its order.

    Columns are renamed if present; a missing one gets its default or null; values that cannot be cast become null.
    ``casts`` gives the expression for columns that need more than a cast.
    """
    df = conform_names(df, renames or {})
    require_columns(df, required)
    defaults, casts = defaults or {}, casts or {}
    out = []
    for field in schema.fields:
        if field.name in df.columns:
            value = casts.get(field.name, F.col(field.name))
            value = value if field.name in casts else value.try_cast(field.dataType)
        else:
            value = F.lit(defaults.get(field.name)).cast(field.dataType)
        out.append(value.alias(field.name))
    return df.select(*out)


def _floats(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def nulls_only(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers as null."""
    return df.withColumns({c: finite(c) for c in _floats(df)})


def bad_values(df: DataFrame, order: Sequence[str], limit: int | None = None) -> DataFrame:
    """Rows that hold a NaN or infinite number, by ``order``, with the columns concerned; only the first ``limit`` if given."""
    found = F.array_compact(
        F.array(*[F.when(F.col(c).isNotNull() & finite(c).isNull(), F.lit(c)) for c in _floats(df)])
    )
    bad = df.withColumn("bad_columns", found).where(F.size("bad_columns") > 0).orderBy(*order)
    return bad if limit is None else bad.limit(limit)
