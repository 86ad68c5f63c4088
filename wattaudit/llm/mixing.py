"""Mixing sources to target weights: hash-random order within each source, cut at its budget of words.

Every document has a key that looks random but is always the same. In the order of keys a source's documents are taken
whole, once per full epoch, and once more up to the point where the rest of the budget is used up. That point is found by
prefix sums over ranges of keys: the sums of 256 ranges per source, then of 256 ranges within the one that holds the cut,
and so on, so that each step sums in Spark and returns at most 256 rows per source, however large a source is.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattaudit.llm.base import stored

SPACE = r"[\x20\x09-\x0D]"
#: Hexadecimal digits of a key that one step of the search settles: 256 ranges.
DIGITS = 2
KEY_DIGITS = 32


def word_count(text: str | Column) -> Column:
    """Number of words; null counts none. Each word with the space around it becomes one letter, then letters count."""
    text = F.col(text) if isinstance(text, str) else text
    word = rf"{SPACE}*+[^\x20\x09-\x0D]++{SPACE}*+"
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.length(F.regexp_replace(text, word, "x"))).otherwise(0).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...], cap: int) -> list[float]:
    """Words wanted of each source: shares of the total by weight, at most ``cap`` times its size, the excess reshared."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    full: set[int] = set()
    while True:
        rest = sum(sizes) - sum(cap * sizes[i] for i in full)
        among = sum(w for i, w in enumerate(weight) if i not in full)
        over = {i for i, w in enumerate(weight) if i not in full and rest * w > cap * sizes[i] * among}
        if not over:
            return [float(cap * s) if i in full else rest * weight[i] / among for i, s in enumerate(sizes)]
        full |= over


@dataclass
class Cut:
    """How much of a source is taken: all of it ``epochs`` times, and once more the keys up to ``last`` inclusive."""

    source: str | None
    size: int
    target: float
    epochs: int
    rest: float
    prefix: str = ""
    last: str = ""
    open: bool = True


def _descend(keyed: DataFrame, cuts: dict[str | None, Cut]) -> None:
    """Settle the next digits of every open cut."""
    spark = keyed.sparkSession
    at = len(next(c.prefix for c in cuts.values() if c.open))
    todo = [c for c in cuts.values() if c.open]
    # Arrow tables become local relations; from Python rows executors would start Python workers that only copy them.
    todo = spark.createDataFrame(pa.table({"source": pa.array([c.source for c in todo], pa.string()), "prefix": pa.array([c.prefix for c in todo], pa.string())}))
    sums = (
        keyed.join(F.broadcast(todo), keyed["source"].eqNullSafe(todo["source"]) & F.col("key").startswith(F.col("prefix")))
        .groupBy(keyed["source"], F.substring("key", at + 1, DIGITS).alias("digits"))
        .agg(F.sum("size").alias("size"), F.min("key").alias("first"), F.max("key").alias("last"))
        .collect()
    )
    for cut in cuts.values():
        if not cut.open:
            continue
        cut.open, prefix = False, cut.prefix
        for digits, size, first, last in sorted((r[1:] for r in sums if r[0] == cut.source)):
            if first == last:  # one key: its documents are taken or left together, whichever comes nearer
                if 2 * cut.rest < size:
                    break
            elif cut.rest < size:
                cut.prefix, cut.open = prefix + digits, True
                break
            cut.rest, cut.last = cut.rest - size, last


def with_copies(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 0) -> DataFrame:
    """``docs`` with the columns size, source_size, target, copies: how often the mix takes each document.

    Sources in order of code points, null last, have the ``weights`` in turn and share all words of the table by weight;
    a source gets at most ``cap`` times its own words and the excess is shared among the others. ``docs`` needs doc_id,
    text and source; other columns pass through and must not have the names of the new ones. A null text has size 0.
    Documents that agree in id and size have one key and are taken alike. A table without words takes nothing; an empty
    table gives no rows. The plan has one row per source, which is what is broadcast.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"),
                         F.col("__size").cast("string")).cast("binary"))
    sized = docs.withColumn("__size", word_count("text")).withColumn("__key", key)
    keyed = stored(sized.select(F.col("source"), F.col("__size").alias("size"), F.col("__key").alias("key")), "keys")
    found = sorted(keyed.groupBy("source").agg(F.sum("size")).collect(), key=lambda r: (r[0] is None, r[0] or ""))
    cuts: dict[str | None, Cut] = {}
    for (source, size), target in zip(found, targets([r[1] for r in found], weights, cap), strict=False):
        epochs = int(target // size) if size else 0
        cuts[source] = Cut(source, size, target, epochs, target - epochs * size)
    while any(c.open for c in cuts.values()):
        _descend(keyed, cuts)
    plan = docs.sparkSession.createDataFrame(pa.table({
        "__source": pa.array([c.source for c in cuts.values()], pa.string()),
        "source_size": pa.array([c.size for c in cuts.values()], pa.int64()),
        "target": pa.array([c.target for c in cuts.values()], pa.float64()),
        "__epochs": pa.array([c.epochs for c in cuts.values()], pa.int32()),
        "__last": pa.array([c.last for c in cuts.values()], pa.string()),
    }))
    return (
        sized.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("copies", F.col("__epochs") + (F.col("__key") <= F.col("__last")).cast("int"))
        .withColumnRenamed("__size", "size")
        .drop("__key", "__source", "__epochs", "__last")
    )


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies): what the mix takes of every document, in words."""
    needed = docs.select("doc_id", "text", "source")
    return with_copies(needed, **options).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
           FROM documents),
k AS (SELECT *, md5(concat('0:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', CAST(size AS VARCHAR))) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n
      FROM k GROUP BY source),
w AS (SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
f AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, n
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
             CAST(sum(weight) OVER (ORDER BY 3.0 * source_size / weight, n
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS among FROM w),
l AS (SELECT rest, among FROM f WHERE rest * weight <= 3 * source_size * among
      ORDER BY 3.0 * source_size / weight, n LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN l.rest * weight > 3 * source_size * l.among THEN CAST(3 * source_size AS DOUBLE)
             ELSE CAST(l.rest * weight AS DOUBLE) / CAST(l.among AS DOUBLE) END AS target FROM f CROSS JOIN l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
g AS (SELECT source, key, sum(size) AS mass FROM k GROUP BY source, key),
c AS (SELECT *, sum(mass) OVER (PARTITION BY source ORDER BY key) - mass AS before FROM g)
SELECT k.doc_id, k.size, e.source_size, e.target,
       CAST(k.size * (e.epochs + CASE WHEN 2 * c.before + c.mass <= 2 * (e.target - e.epochs * e.source_size)
                                      THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(e.epochs + CASE WHEN 2 * c.before + c.mass <= 2 * (e.target - e.epochs * e.source_size)
                            THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
JOIN c ON k.source IS NOT DISTINCT FROM c.source AND k.key = c.key
"""
