"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are rotated to principal axes, so that leading coordinates hold most of a vector. They are ordered by the first
one and cut into tiles of about equal size; two tiles are compared only if their intervals come near enough for the
wanted cosine. Within a pair of tiles the products over the leading coordinates are accumulated first, and the product of
the remaining norms bounds what the rest can add: where the bound stays below the threshold, the pair is dropped. What is
left is compared in full, in double precision, on the given components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattaudit.llm.base import stored
from wattaudit.llm.components import components, local_forest

#: Vectors of a tile, and the bounded sample that gives axes and tile limits (documented limits of the fit alone).
TILE, SAMPLE = 2048, 20_000
#: Leading coordinates after which the bound is tried, in turn.
LEADING = (8, 16, 32)
#: Rows of a tile that are compared at once, and pairs that are looked at in full at once.
ROWS, PAIRS = 256, 32_768
#: Slack for rounding in the bounds; the full comparison has none.
SLACK = 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` with length one; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def axes(sample: np.ndarray) -> np.ndarray:
    """Orthonormal principal axes of unit vectors, strongest first, as columns. They need no centre: cosines have none."""
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1].copy()


def _survivors(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose cosine may reach ``least``; la, lb: leading coordinates and the norms that remain."""
    first = min(LEADING[0], a.shape[1])
    bound = np.hstack([a[:, :first], la[0][:, None]]) @ np.hstack([b[:, :first], lb[0][:, None]]).T
    i, j = np.nonzero(bound >= least - SLACK)
    if not len(i):
        return i, j
    done, so_far = first, bound[i, j] - la[0][i] * lb[0][j]
    for level, upto in enumerate(LEADING[1:], 1):
        upto = min(upto, a.shape[1])
        keep = []
        for at in range(0, len(i), PAIRS):
            part = slice(at, at + PAIRS)
            so_far[part] += np.einsum("ij,ij->i", a[i[part], done:upto], b[j[part], done:upto])
            keep.append(so_far[part] + la[level][i[part]] * lb[level][j[part]] >= least - SLACK)
        kept = np.concatenate(keep)
        i, j, so_far, done = i[kept], j[kept], so_far[kept], upto
        if not len(i):
            break
    return i, j


def _linked(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which pairs (i of x, j of y) of unit vectors have a cosine of at least ``least``."""
    parts = [np.einsum("ij,ij->i", x[i[at : at + PAIRS]], y[j[at : at + PAIRS]]) for at in range(0, len(i), PAIRS)]
    return np.concatenate(parts) >= least if parts else np.zeros(0, bool)


def compare(x: np.ndarray, weight: np.ndarray, side: np.ndarray, rotation: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked weight and smallest linked row of each row of a pair of tiles (``side`` false, true) or of one tile."""
    unit = _unit(x)
    rotated = unit @ rotation[:, : LEADING[-1]]
    squares = np.cumsum(rotated**2, axis=1)
    norms = [np.sqrt(np.maximum(0.0, 1 - squares[:, min(n, rotated.shape[1]) - 1]) + SLACK**2) for n in LEADING]
    left, right = np.nonzero(~side)[0], np.nonzero(side)[0]
    one = not len(right)
    if one:
        right = left
    links, root = np.zeros(len(x)), np.arange(len(x))
    at_right = [n[right] for n in norms]
    for at in range(0, len(left), ROWS):
        rows = left[at : at + ROWS]
        i, j = _survivors(rotated[rows], rotated[right], [n[rows] for n in norms], at_right, least)
        if one:
            above = right[j] > rows[i]
            i, j = i[above], j[above]
        i, j = rows[i], right[j]
        hit = _linked(unit, unit, i, j, least)
        i, j = i[hit], j[hit]
        links += np.bincount(i, weight[j], len(x)) + np.bincount(j, weight[i], len(x))
        root = local_forest(len(x), i, j, root)
    return links, root


def near_vectors(table: DataFrame, least: float = 0.95, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``table`` (vec_id, embedding; others are not read).

    Vectors link when their cosine is ``least`` or more. ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest vec_id reachable, ``kept`` says whether the row has that id. Null, empty and zero
    vectors, and vectors with null or non-finite components, link with nothing; nor do vectors of different length, or
    rows without vec_id (their component_id is null and they are not kept). Equal vectors are compared once and counted
    each; rows that repeat id and vector are all kept or not. Pairs are never listed: a pair of tiles returns the weight
    linked to each row and a forest of its links, so a group of copies costs rows in proportion to its size.
    """
    spark = table.sparkSession
    vec = F.col("embedding")
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    valid = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists(vec, lambda v: v != 0), F.lit(False))
    given = table.select(F.col("vec_id").cast("long"), "embedding").withColumn("valid", valid)
    distinct = given.where("valid").groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    distinct = stored(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")

    counts = {r[0]: r[1] for r in distinct.groupBy(F.size("embedding")).count().collect()}
    chosen = F.lit(False)
    for size, n in counts.items():
        limit = min(2**63 - 1, -(2**63) + int(min(1.0, SAMPLE / n) * (2**64 - 1)))
        chosen |= (F.size("embedding") == size) & (F.xxhash64("node", "first_id") <= limit)
    sample: dict[int, list] = {size: [] for size in counts}
    for (vector,) in distinct.where(chosen).select("embedding").limit(2 * SAMPLE * max(1, len(counts))).collect():
        sample[len(vector)].append(vector)
    fit: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size, vectors in sample.items():
        unit = _unit(np.array(vectors, np.float64).reshape(-1, size)) if vectors else np.zeros((0, size))
        rotation = axes(unit) if vectors else np.eye(size)
        ranges = -(-counts[size] // tile)
        limits = np.quantile(unit @ rotation[:, 0], np.arange(1, ranges) / ranges) if vectors else np.zeros(0)
        fit[size] = (rotation, np.unique(limits))
    shared = spark.sparkContext.broadcast(fit)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            first, ordinal = np.zeros(len(sizes)), np.zeros(len(sizes), np.int32)
            for size in np.unique(sizes):
                rows = np.nonzero(sizes == size)[0]
                rotation, limits = shared.value[int(size)]
                first[rows] = _unit(_matrix(batch.column(0).take(pa.array(rows)))) @ rotation[:, 0]
                ordinal[rows] = np.searchsorted(limits, first[rows], side="right")
            columns = [*batch.columns, pa.array(sizes.astype(np.int32)), pa.array(ordinal), pa.array(first)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "size", "range", "first"])

    names = distinct.select("embedding", "node", "copies")
    schema = names.withColumns({"size": F.lit(0), "range": F.lit(0), "first": F.lit(0.0)}).schema
    placed = stored(names.mapInArrow(place, schema), "placed")
    ranges = placed.groupBy("size", "range").agg(F.count("*").alias("n"), F.min("first").alias("low"), F.max("first").alias("high"))
    # A range that holds a large group of near copies has many vectors; it is cut into several tiles by hash.
    reach = float(np.sqrt(2 - 2 * least)) + SLACK if least < 1 else SLACK
    tiles: list[tuple] = []
    for r in sorted(ranges.collect()):
        tiles += [(r["size"], r["range"], k, -(-r["n"] // tile), r["low"], r["high"]) for k in range(-(-r["n"] // tile))]
    tile_of = {(t[0], t[1], t[2]): i for i, t in enumerate(tiles)}
    partners = []
    for i, (size, own, part, parts, _, high) in enumerate(tiles):
        last = i
        while last + 1 < len(tiles) and tiles[last + 1][0] == size and tiles[last + 1][4] - high <= reach:
            last += 1
        first = next(k for k in range(0, i + 1) if tiles[k][0] == size and tiles[i][4] - tiles[k][5] <= reach)
        partners.append((size, own, part, parts, tile_of[(size, own, part)], first, last))
    deal = spark.createDataFrame(partners, "size int, range int, part int, parts int, own int, first_tile int, last_tile int")
    parts = deal.select("size", "range", "parts").distinct()
    dealt = (
        placed.drop("first")
        .join(F.broadcast(parts), ["size", "range"])
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .join(F.broadcast(deal.drop("parts")), ["size", "range", "part"])
        .withColumn("other", F.explode(F.sequence("first_tile", "last_tile")))
        .select(F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                (F.col("own") > F.col("other")).alias("side"), "node", "copies", "embedding")
    )

    def run(rows: pa.Table) -> pa.Table:
        x = _matrix(rows["embedding"])
        node, weight = rows["node"].to_numpy(), rows["copies"].to_numpy().astype(np.float64)
        low, high = rows["low"][0].as_py(), rows["high"][0].as_py()
        side = rows["side"].to_numpy()
        if low != high and (side.all() or not side.any()):
            keep = np.zeros(0, np.int64)
            links, root = np.zeros(len(x)), np.arange(len(x))
        else:
            links, root = compare(x, weight, side, shared.value[x.shape[1]][0], least)
            keep = np.nonzero(links)[0]
        return pa.table({"node": node[keep], "links": links[keep].astype(np.int64), "root": node[root[keep]]})

    found = stored(dealt.groupBy("low", "high").applyInArrow(run, "node long, links long, root long"), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    rooted = (
        distinct.join(links, "node", "left").join(roots, "node", "left")
        .select("embedding", "first_id", F.coalesce("root", "node").alias("root"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    rooted = stored(rooted, "vector-roots")
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(named, "root").select("embedding", "n_links", "component_id")
    linked = given.where("valid").join(classes, "embedding").select("vec_id", "n_links", "component_id")
    alone = given.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
