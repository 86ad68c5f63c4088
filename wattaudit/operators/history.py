"""Ordered per-account work that survives a hot account.

Window functions put all rows of a partition key into one task. Most accounts are short, so they simply use one window
per account. An account that holds more than ``hot_rows`` bills is cut into chunks of consecutive bills:

1. ``profile`` counts bills per account (combined on the map side). Every account above ``hot_rows`` is hot, however
   many there are. The list of hot accounts is written once; up to ``max_hot`` rows it is broadcast, beyond that it is
   joined with the bills spread over salts.
2. Every bill of a hot account gets its exact position: bills before its day, plus bills before its slab of ids in that
   day, plus its place in the slab. A day window has at most one row per calendar day, a slab window at most one row per
   slab. A slab spans ``slab_ids`` consecutive ids, so it holds no more bills than that (ids are unique), or one
   ``MAX_SLABS``-th of the account's id range if that is wider (hashed ids).
3. ``chunk = position div chunk_rows``. The last ``lookback`` bills of a chunk are copied into the next one and the first
   ``lookahead`` into the previous one, marked ``is_halo``. Any frame within these bounds is then exact inside
   (account, chunk), and halo rows are dropped after the window.

No row is lost or sampled. A job without hot accounts pays only for the counting, and then has one window per account.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattaudit.operators.lookups import lookup_join
from wattaudit.session import work_dir

MAX_SLABS = 1 << 20
_INTERNAL = ("_key", "hot_min_id", "hot_max_id")


@dataclass(frozen=True)
class HotKeys:
    """When a key counts as hot and how finely its rows are cut."""

    hot_rows: int = 1_000_000
    max_hot: int = 10_000
    chunk_rows: int = 500_000
    slab_ids: int = 1_000_000


def profile(df: DataFrame, key: str, row_id: str, **stats: Column) -> DataFrame:
    """Per key: rows as ``n_rows``, the range of ids, and further aggregates."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(row_id).alias("min_id"),
        F.max(row_id).alias("max_id"),
        *[c.alias(n) for n, c in stats.items()],
    )


def _named(key: str) -> Column:
    """Key for joins; null is a key like any other."""
    return F.coalesce(F.col(key).cast("string"), F.lit("\0"))


def hot_keys(profiled: DataFrame, key: str, hot: HotKeys) -> DataFrame:
    """All keys above the threshold as (_key, hot_<stat> …)."""
    stats = {s: f"hot_{s}" for s in profiled.columns if s != key}
    large = profiled.where(F.col("n_rows") > hot.hot_rows).withColumn("_key", _named(key))
    return large.drop(key).withColumnsRenamed(stats)


def positions(df: DataFrame, day: str, row_id: str, hot: HotKeys) -> DataFrame:
    """Add ``position`` (0-based rank by day, then id, within ``_key``) without any window over a whole key.

    ``df`` holds rows of hot keys, with ``_key``, ``hot_min_id`` and ``hot_max_id``.
    """
    id_range = F.col("hot_max_id").cast("double") - F.col("hot_min_id").cast("double")
    width = F.greatest(F.lit(float(hot.slab_ids)), id_range / F.lit(float(MAX_SLABS)))
    # Null days sort first, as in an ascending window. Rounding of ids to double keeps their order.
    df = df.withColumns(
        {
            "_day": F.coalesce(F.unix_date(day), F.lit(-(2**31))),
            "_slab": F.floor(F.col(row_id).cast("double") / width).cast("long"),
        }
    )
    slabs = df.groupBy("_key", "_day", "_slab").agg(F.count(F.lit(1)).alias("_n"))
    days = slabs.groupBy("_key", "_day").agg(F.sum("_n").alias("_n"))
    by_day = W.partitionBy("_key").orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    by_slab = W.partitionBy("_key", "_day").orderBy("_slab").rowsBetween(W.unboundedPreceding, -1)
    days = days.select("_key", "_day", F.coalesce(F.sum("_n").over(by_day), F.lit(0)).alias("_before_day"))
    slabs = slabs.select("_key", "_day", "_slab", F.coalesce(F.sum("_n").over(by_slab), F.lit(0)).alias("_before_slab"))
    offsets = slabs.join(days, ["_key", "_day"])
    in_slab = F.row_number().over(W.partitionBy("_key", "_day", "_slab").orderBy(row_id)) - 1
    return (
        df.join(offsets, ["_key", "_day", "_slab"])
        .withColumn("position", F.col("_before_day") + F.col("_before_slab") + in_slab)
        .drop("_day", "_slab", "_before_day", "_before_slab")
    )


def cut(
    df: DataFrame,
    key: str,
    day: str,
    row_id: str,
    profiled: DataFrame,
    lookback: int,
    lookahead: int = 0,
    hot: HotKeys = HotKeys(),
) -> DataFrame:
    """Add ``chunk``, ``is_halo`` and ``hot_<stat>`` columns; windows then partition by (key, chunk).

    ``hot_<stat>`` carries the whole-key aggregates of hot keys (null for the others, whose rows are all in one chunk and
    can be aggregated by the window itself).
    """
    if hot.chunk_rows < max(lookback, lookahead):
        raise ValueError("a chunk must be at least as long as the halo")
    largest = hot_keys(profiled, key, hot)
    # Read once, so that every use below sees the same accounts; mostly there are none.
    found = largest.limit(hot.max_hot + 1).collect()
    whole = {"position": F.lit(None).cast("long"), "chunk": F.lit(0).cast("long"), "is_halo": F.lit(False)}
    if not found:
        unknown = {c: F.lit(None).cast(largest.schema[c].dataType) for c in largest.columns if c not in _INTERNAL}
        return df.withColumns({**whole, **unknown})
    df = df.withColumn("_key", _named(key))
    if len(found) > hot.max_hot:
        path = work_dir(df.sparkSession, "hot-keys")
        largest.write.parquet(path)
        large = df.sparkSession.read.schema(largest.schema).parquet(path)
    else:
        large = df.sparkSession.createDataFrame(found, largest.schema)
    tagged = lookup_join(df, large, ["_key"], max_rows=hot.max_hot, spread=F.col(row_id))
    short = tagged.where(F.col("hot_n_rows").isNull()).withColumns(whole)
    size = hot.chunk_rows
    place = F.pmod(F.col("position"), F.lit(size))
    own = F.expr(f"position div {size}")
    copies = F.array_compact(
        F.array(
            F.struct(own.alias("chunk"), F.lit(False).alias("is_halo")),
            F.when(place >= size - lookback, F.struct((own + 1).alias("chunk"), F.lit(True).alias("is_halo"))),
            F.when(place < lookahead, F.struct((own - 1).alias("chunk"), F.lit(True).alias("is_halo"))),
        )
    )
    long = (
        positions(tagged.where(F.col("hot_n_rows").isNotNull()), day, row_id, hot)
        .withColumn("_copy", F.explode(copies))
        .withColumns({"chunk": F.col("_copy.chunk"), "is_halo": F.col("_copy.is_halo")})
        .drop("_copy")
    )
    return short.unionByName(long).drop(*_INTERNAL)


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: Column,
    out: str,
    kind: str = "last",
    inclusive: bool = True,
    descending: bool = False,
    width: int = 10_000,
) -> DataFrame:
    """Running value along an integer order within ``keys``, without a window over a whole key.

    ``kind`` is ``last`` (latest non-null value) or ``sum``. Rows are cut into blocks of ``width`` consecutive order
    values; a block is summed up on its own, and what the earlier blocks amount to is carried in from a table with one
    row per block. ``descending`` runs from the highest order value down.
    """
    if kind not in ("last", "sum"):
        raise ValueError("kind is 'last' or 'sum'")
    df = df.withColumns({"_value": value, "_block": F.expr(f"`{order}` div {width}")})
    block_keys = [*keys, "_block"]

    def along(by: list[str], column: str, end: int) -> W:
        sort = F.desc(column) if descending else F.asc(column)
        return W.partitionBy(*by).orderBy(sort).rowsBetween(W.unboundedPreceding, end)

    def step(column: str, window: W) -> Column:
        return F.last(column, ignorenulls=True).over(window) if kind == "last" else F.sum(column).over(window)

    if kind == "sum":
        total = F.sum("_value")
    else:
        pick = F.min_by if descending else F.max_by
        total = pick("_value", F.when(F.col("_value").isNotNull(), F.col(order)))
    blocks = df.groupBy(*block_keys).agg(total.alias("_total"))
    carried = blocks.select(*block_keys, step("_total", along(keys, "_block", -1)).alias("_carried"))
    inner = step("_value", along(block_keys, order, 0 if inclusive else -1))
    # A left join: rows without a key stay.
    joined = df.join(carried, block_keys, "left").withColumn("_inner", inner)
    if kind == "sum":
        zero = F.lit(0)
        result = F.coalesce("_inner", zero) + F.coalesce("_carried", zero)
    else:
        result = F.coalesce("_inner", "_carried")
    return joined.withColumn(out, result).drop("_value", "_block", "_carried", "_inner")
