"""Joins of a large table with a dimension, and bounded reads of small tables.

A dimension is broadcast only after its rows and its bytes (as JSON) have been checked. Beyond a bound the join is a shuffle join whose
large side is salted, so that one hot key (a third of all bills in one month of one class, say) is spread over
``salts`` tasks; the dimension is copied once per salt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Keys of which each has more than one MOST_HOT-th of all rows are as many at most.
MOST_HOT = 10_000
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 32 << 20
SALTS = 64


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True if ``df`` has at most ``max_rows`` rows of ``max_bytes`` together; reads no more than one row beyond that."""
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))
    rows, used = df.limit(max_rows + 1).agg(F.count(F.lit(1)), size).first()
    return rows <= max_rows and used <= max_bytes


def bounded_rows(df: DataFrame, max_rows: int, what: str) -> list[Row]:
    """Rows of a table that must be small (distinct condition texts, say); fails loudly when it is not."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} {what}")
    return rows


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    residual: Column | None = None,
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
    spread: Column | None = None,
) -> DataFrame:
    """Join ``facts`` with ``dim`` on equal keys plus an optional residual condition.

    ``on`` names columns of both sides; the copies of ``dim`` are dropped from the result. ``how`` is ``left`` or
    ``inner``. ``spread`` is hashed into the salt (default: the whole fact row).
    """
    keys = {k: f"_dim_{k}" for k in on}
    dim = dim.withColumnsRenamed(keys)
    condition = F.lit(True)
    for key, copy in keys.items():
        condition = condition & (F.col(key) == F.col(copy))
    if residual is not None:
        condition = condition & residual
    if fits(dim, max_rows):
        return facts.join(F.broadcast(dim), condition, how).drop(*keys.values())
    spread = F.xxhash64(*[F.col(c) for c in facts.columns]) if spread is None else F.xxhash64(spread)
    salted = facts.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int"))
    copies = dim.withColumn("_dim_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    condition = condition & (F.col("_salt") == F.col("_dim_salt"))
    # Spark takes the copies for as small as the dimension and would broadcast them without the hint.
    return salted.join(copies.hint("merge"), condition, how).drop("_salt", "_dim_salt", *keys.values())


def join_counted(left: DataFrame, right: DataFrame, on: Sequence[str], rows: str, how: str = "left") -> DataFrame:
    """Join with ``right``, whose keys are unique and whose column ``rows`` says how many rows of ``left`` have the key.

    Keys with more than one MOST_HOT-th of all rows number MOST_HOT at most: those are looked up like a dimension, broadcast if they fit the
    bounds and else salted, so that the rows of a hot key are no task's burden. All others meet in a shuffle, where no key has more rows than
    that. Keys must not be null; ``rows`` is not in the result.
    """
    on = list(on)
    total, top = right.agg(F.sum(rows).cast("double"), F.max(rows)).first()
    most = max((total or 0) / MOST_HOT, 1_000.0)
    if (top or 0) <= most:
        return left.join(right.drop(rows), on, how)
    hot, cold = (right.where(c).drop(rows) for c in (F.col(rows) > most, F.col(rows) <= most))
    marked = left.join(F.broadcast(hot.select(*on, F.lit(True).alias("_hot"))), on, "left")
    found = lookup_join(marked.where("_hot").drop("_hot"), hot, on, how="inner", max_rows=MOST_HOT)
    return found.unionByName(marked.where("_hot is null").drop("_hot").join(cold, on, how))
