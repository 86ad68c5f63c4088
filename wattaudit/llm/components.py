"""Connected components of a graph of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattaudit.llm.base import stored


def local_forest(size: int, left: np.ndarray, right: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable position of each of ``size`` positions, by the links left-right, going on from ``root``."""
    root = np.arange(size) if root is None else root
    while len(left):
        a, b = root[left], root[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        if not open_.any():
            break
        left, right, low, high = left[open_], right[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return root


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b, both long); root is the smallest node reachable.

    Each round joins and aggregates with partial sums only, so a node with very many links is no task's burden: the
    aggregation sees it combined, and the join on it can be split. Rounds grow with the logarithm of a chain's length.
    Every round is written to the shared folder. Empty links give no rows; self links are no links.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
        )
        edges = stored(small.where("u <> v").distinct(), "small-star")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select("v", "v").distinct()
    )
