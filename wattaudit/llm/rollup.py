"""Sums over the subtrees of a forest, by centroid decomposition.

A component is a connected part of the forest; it is named by its top. Every node carries ``mass``, the weight of its subtree
within its component, and every node has a weight of at least one. The nodes whose mass is at least half of the component's
are a path from the top down; the lowest of them is the centroid. Without it, the component falls into the parts below its children
and the rest above, none heavier than half. What the component holds below the centroid, itself included, is the centroid's
own sum within the component, and it is added to all nodes on the path from the centroid to the top. So every node gets its sum in pieces,
one for each component in which it lay above the centroid and one for the component whose centroid it is, and there are as many rounds as
the logarithm of the weight: long chains and wide stars alike.

Which part a node goes to is looked up, not walked: ``paths`` knows, for a member that passes through the node, the member's node at
every depth. Components up to ``local`` are finished in tasks, many at a time, by the same steps on arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattaudit.llm.base import stored, whole_groups
from wattaudit.operators.lookups import join_counted

#: Weight up to which a component is finished within a task; it has no more nodes than that.
LOCAL = 65_536


def _preorder(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes in preorder and the number of nodes of each subtree, by position in that order. Tops have parent -1."""
    children: list[list[int]] = [[] for _ in parent]
    stack = []
    for node, up in enumerate(parent.tolist()):
        (children[up] if up >= 0 else stack).append(node)
    order = []
    while stack:
        node = stack.pop()
        order.append(node)
        stack += children[node]
    order = np.array(order, np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    size = np.ones(len(order), np.int64)
    for at in range(len(order) - 1, 0, -1):
        up = parent[order[at]]
        if up >= 0:
            size[place[up]] += size[at]
    return order, size


def decompose(parent: np.ndarray, mass: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree sums of ``values`` (nodes, columns) in a forest given by parent positions (-1: a top)."""
    order, size = _preorder(parent)
    place = np.full(len(order) + 1, -1)
    place[order] = np.arange(len(order))
    up, mass, values = place[parent[order]], mass[order].copy(), values[order]
    sums = np.zeros_like(values)
    # A component is an array of places, ascending, its top first.
    tops = np.nonzero(up < 0)[0]
    work = [np.arange(t, t + size[t]) for t in tops]
    while work:
        part = work.pop()
        if len(part) == 1:
            sums[part] += values[part]
            continue
        path = part[2 * mass[part] >= mass[part[0]]]
        centroid = path[-1]
        begin, end = np.searchsorted(part, (centroid, centroid + size[centroid]))
        sums[path] += values[part[begin:end]].sum(axis=0)
        mass[path[:-1]] -= mass[centroid]
        below = part[begin + 1 : end]
        work += np.split(below, np.nonzero(up[below] == centroid)[0][1:]) if len(below) else []
        if len(part) > len(below) + 1:
            work.append(np.concatenate([part[:begin], part[end:]]))
    out = np.empty_like(sums)
    out[order] = sums
    return out


def _finish(small: DataFrame, values: list[str]) -> DataFrame:
    """(key, values): the sums of nodes whose components are small, with what they have got already."""
    n = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches):
            keys, ups, tops = (rows.column(i).to_pylist() for i in range(1, 4))
            place = {k: i for i, k in enumerate(keys)}
            parent = np.array([-1 if k == top else place[up] for k, up, top in zip(keys, ups, tops, strict=True)], np.int64)
            numbers = [rows.column(i).to_numpy() for i in range(4, 5 + 2 * n)]
            if len(parent):
                own, got = np.stack(numbers[1 : n + 1], axis=1), np.stack(numbers[n + 1 :], axis=1)
                sums = got + decompose(parent, numbers[0], own)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *map(pa.array, sums.T)], ["key", *values])

    dealt = small.select(F.xxhash64("component").alias("group"), "key", "parent", "component", "mass", *values, *[f"got_{v}" for v in values])
    schema = "key binary, " + ", ".join(f"{v} long" for v in values)
    return dealt.repartition("group").sortWithinPartitions("group").mapInArrow(run, schema)


def rollup(nodes: DataFrame, paths: DataFrame, values: list[str], local: int = LOCAL) -> DataFrame:
    """(key, <values>): for every node the sum of each of ``values`` over its subtree, itself included.

    ``nodes``: key and parent (binary, the parent null for a top), depth, member (long, of those that pass through the node), mass (the
    weight of the node's whole subtree, every node weighing one at least), and the values (long). ``paths``: member, depth,
    key and parent of every node on the way of every member that ``nodes`` names, tops apart. Keys are unique. An empty
    forest gives no rows.
    """
    tops = nodes.where("parent is null").select("key", "mass").limit(2).collect()
    if len(tops) > 1:
        raise ValueError("join several trees below one top")
    top, whole = tops[0] if tops else (b"", 0)
    got = [f"got_{v}" for v in values]
    named = {"component": F.lit(bytes(top)), "whole": F.lit(whole)}
    state = nodes.withColumns(named | {g: F.lit(0).cast("long") for g in got})
    done, small = [], []
    while True:
        small.append(state.where(F.col("whole") <= local))
        large = state.where(F.col("whole") > local)
        on_path = 2 * F.col("mass") >= F.col("whole")
        found = F.min(F.struct("mass", "depth", "key"))
        centroids = stored(large.where(on_path).groupBy("component").agg(found.alias("c")), "centroids")
        if centroids.isEmpty():
            break
        # One row for each component and member, so that no member is looked up more than once in a component.
        members = large.groupBy("component", "member").agg(F.count(F.lit(1)).alias("rows"))
        asked = members.join(centroids, "component")
        ways = paths.select("member", (F.col("depth") - 1).alias("_depth"), F.col("key").alias("child"), F.col("parent").alias("_above"))
        asked = asked.join(ways, (asked["member"] == ways["member"]) & (asked["c.depth"] == ways["_depth"]), "left").select(
            "component", asked["member"], "c", "rows", F.when(F.col("_above") == F.col("c.key"), F.col("child")).alias("child")
        )
        asked = stored(asked, "ways")
        met = join_counted(large, asked, ["component", "member"], "rows", "inner")
        below = F.col("child").isNotNull() & (F.col("depth") > F.col("c.depth"))
        own = F.col("key") == F.col("c.key")
        # The part above keeps the component's name, the parts below are named by the centroid's children.
        part = F.when(own, F.lit(None)).when(below, F.col("child")).otherwise(F.col("component"))
        dealt = stored(met.select(*state.columns, "c", part.alias("part"), own.alias("own"), (own | below).alias("under")), "parts")
        sums = dealt.groupBy("component").agg(
            *[F.sum(F.when(F.col("under"), F.col(v)).otherwise(0)).alias(f"sum_{v}") for v in values],
            F.sum(F.when(on_path, 1).otherwise(0)).alias("rows"),
        )
        path = join_counted(dealt.where(on_path), stored(sums, "sums"), ["component"], "rows", "inner")
        rest = dealt.where(~on_path)
        path = path.withColumns({g: F.col(g) + F.col(f"sum_{v}") for g, v in zip(got, values, strict=True)})
        done.append(stored(path.where("own").select("key", *[F.col(g).alias(v) for g, v in zip(got, values, strict=True)]), "sums-done"))
        above = path.where("not own").withColumn("mass", F.col("mass") - F.col("c.mass"))
        kept = stored(above.select(rest.columns).unionByName(rest).drop("component", "whole", "c", "own", "under").withColumnRenamed("part", "component"), "rest")
        wholes = kept.groupBy("component").agg(F.max("mass").alias("whole"), F.count(F.lit(1)).alias("rows"))
        state = stored(join_counted(kept, stored(wholes, "wholes"), ["component"], "rows", "inner"), "components")
    gathered = small[0]
    for s in small[1:]:
        gathered = gathered.unionByName(s)
    result = _finish(gathered, values)
    for d in done:
        result = result.unionByName(d)
    return result
