"""Centroid clustering over a vector approximation file.

Vectors become integers. Beside each vector lies its approximation: every dimension is cut into a few cells, and only the
cell numbers are kept, a few bits each. For a centroid, tables give the least and the largest squared difference that a cell
allows; their sums over the dimensions bound the distance. Where the largest distance to one centroid is below the least
distance to all others, the cells decide; only where intervals overlap is the full vector taken out of its column, and
only against the centroids that can still win. All arithmetic is on integers, so every result is exact.

A round is one narrow pass over the written table. The approximation and the vector are columns of one row: a join of the
open rows back to a second table would shuffle more than it spares. What comes to the driver is one sum per cluster and dimension.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattaudit.llm.base import stored

#: Largest size of a component, so that a squared distance over 64 dimensions fits a long.
LARGEST = 1 << 27
#: Cuts between cells lie where a normal distribution has equal shares; beyond that any cuts give the same result.
_STEPS = 4096


@dataclass(frozen=True)
class Cells:
    """For every dimension the smallest and the largest value of each cell, both (dimensions, cells)."""

    bits: int
    low: np.ndarray
    high: np.ndarray

    def pack(self, x: np.ndarray) -> np.ndarray:
        """Cell numbers of vectors (n, dimensions), packed to ``bits`` bits each."""
        cells = np.stack([np.searchsorted(self.low[d, 1:], x[:, d], "right") for d in range(x.shape[1])], axis=1)
        places = (cells[:, :, None] >> np.arange(self.bits)) & 1
        return np.packbits(places.astype(np.uint8).reshape(len(x), x.shape[1] * self.bits), axis=1)

    def unpack(self, packed: np.ndarray) -> np.ndarray:
        dims = len(self.low)
        places = np.unpackbits(packed, axis=1, count=dims * self.bits).reshape(-1, dims, self.bits)
        return places @ (1 << np.arange(self.bits))

    def bounds(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest squared difference per (dimension, cell, centroid)."""
        at = centroids.T[:, None, :]
        below, above = self.low[:, :, None] - at, at - self.high[:, :, None]
        return np.maximum(0, np.maximum(below, above)) ** 2, np.maximum(np.abs(below), np.abs(above)) ** 2


def make_cells(low: np.ndarray, high: np.ndarray, mean: np.ndarray, spread: np.ndarray, bits: int) -> Cells:
    """Cells that cover low to high of every dimension, cut at equal shares of a normal distribution."""
    grid = np.linspace(-4, 4, _STEPS)
    share = np.cumsum(np.exp(-(grid**2) / 2))
    cuts = grid[np.searchsorted(share / share[-1], np.arange(1, 1 << bits) / (1 << bits))]
    starts = np.ceil(mean[:, None] + spread[:, None] * cuts).astype(np.int64)
    starts = np.concatenate([low[:, None], np.clip(starts, low[:, None], high[:, None] + 1)], axis=1)
    ends = np.concatenate([starts[:, 1:] - 1, high[:, None]], axis=1)
    return Cells(bits, starts, np.maximum(starts, ends))


def nearest(cells: Cells, packed: np.ndarray, fetch, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """Nearest centroid of each vector (ties: the smaller number), and how many vectors had to be fetched.

    ``fetch`` gives the full vectors of the positions it is called with.
    """
    least, most = cells.bounds(centroids)
    numbers = cells.unpack(packed)
    low = np.zeros((len(packed), len(centroids)), np.int64)
    high = np.zeros_like(low)
    for d in range(len(least)):
        low += least[d][numbers[:, d]]
        high += most[d][numbers[:, d]]
    possible = low <= high.min(axis=1, keepdims=True)
    found = possible.argmax(axis=1)
    open_ = np.nonzero(possible.sum(axis=1) > 1)[0]
    if len(open_):
        x, exact = fetch(open_), np.full((len(open_), len(centroids)), np.iinfo(np.int64).max)
        for c, centroid in enumerate(centroids):
            rows = np.nonzero(possible[open_, c])[0]
            exact[rows, c] = ((x[rows] - centroid) ** 2).sum(axis=1)
        found[open_] = exact.argmin(axis=1)
    return found, len(open_)


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims).astype(np.int64)


def _packed(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def whole_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, x): the vectors that count, as integers floor(scale * component)."""
    x = F.col("embedding")
    sound = F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double") * scale) <= float(LARGEST), F.lit(False)))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("int"))
    return vectors.where((F.size(x) == dims) & sound).select(F.col("vec_id"), whole.alias("x"))


def _statistics(whole: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """Number of vectors, and least, largest, mean and spread of every dimension, over all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column(0), dims)
            if len(x):
                parts = [np.arange(dims), np.full(dims, len(x)), x.min(0), x.max(0), x.sum(0).astype(float), (x.astype(float) ** 2).sum(0)]
                yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], ["d", "n", "low", "high", "total", "squares"])

    parts = whole.select("x").mapInArrow(run, "d long, n long, low long, high long, total double, squares double")
    rows = (
        parts.groupBy("d").agg(F.sum("n").alias("n"), F.min("low"), F.max("high"), F.sum("total"), F.sum("squares"))
        .orderBy("d").collect()
    )
    if not rows:
        return 0, np.zeros((4, dims))
    n = rows[0]["n"]
    low, high, total, squares = (np.array([r[i] for r in rows], float) for i in range(2, 6))
    return n, np.stack([low, high, total / n, np.sqrt(np.maximum(squares / n - (total / n) ** 2, 0))])


def _sums(table: DataFrame, cells: Cells, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Per non-empty cluster its number of vectors and the exact sum of every component."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            x = _vectors(batch.column(1), dims)
            found, _ = nearest(cells, _packed(batch.column(0), (dims * cells.bits + 7) // 8), x.__getitem__, centroids)
            counts += np.bincount(found, minlength=len(centroids))
            for c in np.unique(found):
                totals[c] += x[found == c].sum(axis=0)
        used = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[used]), pa.array(totals[used].tolist(), pa.list_(pa.int64()))], ["c", "n", "x"]
        )

    parts = table.select("cells", "x").mapInArrow(run, "c long, n long, x array<long>")
    rows = (
        parts.select("c", "n", F.posexplode("x").alias("d", "v")).groupBy("c", "d")
        .agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    )
    sums: dict[int, tuple[int, list[int]]] = {}
    for c, d, n, v in rows:
        sums.setdefault(c, (n, [0] * dims))[1][d] = int(v)
    return sums


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, bits: int = 4, seed: str = "1") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that counts.

    ``vectors`` has vec_id and embedding; other columns are not read. A vector counts if it has ``dims`` components, none
    null or non-finite, none beyond LARGEST in size after scaling; the others give no row. Centroids start as the ``k`` vectors
    with the smallest SHA-256 of ``seed:vec_id`` (a missing id counts as the empty text, ties go by the components); with fewer
    vectors there are fewer. Each round assigns every vector to the nearest centroid and moves every non-empty centroid to the floor of
    its mean; then vectors are assigned once more. Ties go to the smaller number. Repeated rows count each. An inertia beyond
    a long is null. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    whole = stored(whole_vectors(vectors, dims, scale), "vectors")
    _, (low, high, mean, spread) = _statistics(whole, dims)
    cells = make_cells(low.astype(np.int64), high.astype(np.int64), mean, spread, bits)
    width = (dims * bits + 7) // 8

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = cells.pack(_vectors(batch.column(1), dims))
            column = pa.array([p.tobytes() for p in packed], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), column, batch.column(1)], ["vec_id", "cells", "x"])

    schema = f"vec_id {whole.schema['vec_id'].dataType.simpleString()}, cells binary, x array<int>"
    table = stored(whole.mapInArrow(approximate, schema), "approximations")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = whole.select(order.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    centroids = np.array([r["x"] for r in first], np.int64).reshape(len(first), dims)
    for _ in range(rounds if first else 0):
        for c, (n, total) in _sums(table, cells, centroids).items():
            centroids[c] = [t // n for t in total]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column(2), dims)
            found, _ = nearest(cells, _packed(batch.column(1), width), x.__getitem__, centroids)
            far = ((x - centroids[found]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32()), pa.array(far)], ["vec_id", "cluster", "distance"])

    schema = schema.split(", ")[0] + ", cluster int, distance long"
    assigned = stored(table.mapInArrow(assign, schema), "assigned")
    # One row per cluster, k at most: read, named and broadcast.
    sums = dict(assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    whole_sum = sum(map(int, sums.values()))
    rows = [(c, int(s), whole_sum, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    rows = [(c, *(v if v < 1 << 63 else None for v in (own, all_)), digest) for c, own, all_, digest in rows]
    totals = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(totals), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _cluster_sql(k: int = 16, rounds: int = 3) -> str:
    far = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: CAST(z[1] - z[2] AS HUGEINT) * (z[1] - z[2])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS (SELECT r, vec_id, x, CAST(m % {k} AS INTEGER) AS cluster, m // {k} AS distance FROM (SELECT v.r, v.vec_id, v.x,"
            f" min({far} * {k} + c.c) AS m FROM v CROSS JOIN c{r} c GROUP BY ALL))"
        )
        if r < rounds:
            steps.append(
                f"s{r} AS (SELECT cluster, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, unnest(range(1, 65)) t(i) GROUP BY ALL),\n"
                f"c{r + 1} AS (SELECT cluster AS c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{r} GROUP BY cluster"
                f" UNION ALL SELECT c, x FROM c{r} WHERE c NOT IN (SELECT cluster FROM a{r}))"
            )
    return f"""
WITH k AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64
           AND len(list_filter(embedding, lambda q: q IS NULL OR NOT isfinite(q) OR abs(64 * CAST(q AS DOUBLE)) > {LARGEST})) = 0),
v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(e, lambda q: CAST(floor(64 * CAST(q AS DOUBLE)) AS BIGINT)) AS x FROM k),
c0 AS (SELECT row_number() OVER (ORDER BY sha256(concat('1:', coalesce(CAST(vec_id AS VARCHAR), ''))), x) - 1 AS c, x FROM v
       QUALIFY c < {k}),
{", ".join(steps)}
SELECT a.vec_id, a.cluster, CAST(a.distance AS BIGINT) AS distance,
       CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.c
"""


CLUSTER_SQL = _cluster_sql()
