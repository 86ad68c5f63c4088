"""SimHash near-duplicates by pigeonring filtering.

A fingerprint is a ring of segments. If two fingerprints differ in at most ``max_bits`` bits, some segment starts a chain
along the ring whose differences, summed over its first l segments, never exceed l * max_bits / segments, for every l.
With one segment more than bits, the first segment of that chain is equal and the second differs in at most one bit, so
one of its halves is equal too. That is the index key; the longer chains prune before the full distance is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattaudit.llm.base import stored, texts, whole_groups, words
from wattaudit.llm.components import components, local_forest

BITS = 64
#: Shingles hashed at a time, and links held before they are reduced to a forest.
BLOCK = 65_536
#: Fingerprints of a bucket that one task compares; larger buckets are cut into tiles and compared tile by tile.
TILE = 1024

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes | None, size: int) -> int:
    """Fingerprint of a text as a signed long; zero for a text without words."""
    found = words(text)
    if not found:
        return 0
    size = min(size, len(found))
    total = len(found) - size + 1
    ones = np.zeros(BITS, np.int64)
    for start in range(0, total, BLOCK):
        part = found[start : min(start + BLOCK, total) + size - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(size)), strict=False))
        hashes = np.fromiter(map(_hash, shingles), np.uint64, len(part) - size + 1)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total).view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, fp) of every document: 64-bit majority of the XXH64 (seed 42) of its word shingles, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, size) for t in texts(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _widths(segments: int) -> list[int]:
    return [BITS // segments + (i < BITS % segments) for i in range(segments)]


def _keys(max_bits: int) -> F.Column:
    """The index keys of a fingerprint: for each segment its value with either half of the next segment."""
    widths = _widths(max_bits + 1)
    ends = np.cumsum([0, *widths])
    keys = []
    for i, width in enumerate(widths):
        j = (i + 1) % len(widths)
        half = widths[j] // 2
        for h, (low, size) in enumerate(((0, half), (half, widths[j] - half))):
            first = F.shiftrightunsigned("fp", int(ends[i])).bitwiseAND((1 << width) - 1)
            second = F.shiftrightunsigned("fp", int(ends[j] + low)).bitwiseAND((1 << size) - 1)
            keys.append((F.shiftleft(first, 32) + F.shiftleft(second, 6) + F.lit(2 * i + h)).cast("long"))
    return F.array(*keys)


def _linked(x: np.ndarray, start: np.ndarray, max_bits: int) -> np.ndarray:
    """Whether differences ``x`` (xor) pass the chain that starts at segment ``start``, then the full distance."""
    segments = max_bits + 1
    widths = _widths(segments)
    ends = np.cumsum([0, *widths])
    masks = np.array([((1 << w) - 1) << int(e) for w, e in zip(widths, ends, strict=False)], np.uint64)
    alive = np.arange(len(x))
    total = np.zeros(len(x), np.uint8)
    for length in range(1, segments):
        segment = (start[alive] + length - 1) % segments
        total = total + np.bitwise_count(x[alive] & masks[segment])
        passed = total <= length * max_bits // segments
        alive, total = alive[passed], total[passed]
    return alive[np.bitwise_count(x[alive]) <= max_bits]


def _forest(group: np.ndarray, cross: np.ndarray, side: np.ndarray, start: np.ndarray, fp: np.ndarray, max_bits: int) -> np.ndarray:
    """Smallest linked row of each row, links within groups only; rows are sorted by group."""
    root, left, right, held = np.arange(len(fp)), [], [], 0
    near, step = np.arange(len(fp)), 0
    while len(near):
        step += 1
        near = near[near + step < len(fp)]
        near = near[group[near + step] == group[near]]
        tried = near[~cross[near] | (side[near] != side[near + step])]
        hits = tried[_linked(fp[tried] ^ fp[tried + step], start[tried], max_bits)]
        left, right, held = [*left, hits], [*right, hits + step], held + len(hits)
        if held > BLOCK:
            root, left, right, held = local_forest(len(fp), np.concatenate(left), np.concatenate(right), root), [], [], 0
    return local_forest(len(fp), np.concatenate(left), np.concatenate(right), root) if held else root


def links(prints: DataFrame, max_bits: int = 4, tile: int = TILE) -> DataFrame:
    """Links (a, b) between the distinct ``fp`` of ``prints`` that join all fingerprints within ``max_bits`` bits.

    Not all pairs: of each bucket's pairs found within the distance, a spanning forest is returned, so a large group of
    near copies costs as many rows as it has members. A bucket above ``tile`` rows is cut into tiles by hash and each
    pair of tiles is compared on its own, so no task holds more than two tiles.
    """
    keyed = prints.select("fp", F.explode(_keys(max_bits)).alias("key"))
    large = keyed.groupBy("key").count().where(F.col("count") > tile)
    dealt = (
        keyed.join(large.select("key", F.ceil(F.col("count") / tile).alias("tiles")), "key", "left")
        .withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        .withColumn("own", F.when(F.col("tiles") > 1, F.pmod(F.xxhash64("fp"), "tiles")).otherwise(F.lit(0)))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        .select("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("group"),
                (F.col("own") != F.col("other")).alias("cross"), (F.col("own") > F.col("other")).alias("side"), "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches):
            group, key, cross, side, fp = (rows.column(i).to_numpy() for i in range(5))
            # Two tiles may meet under one hash by chance; the key keeps them apart as far as it matters for the chain.
            start = (key & 63) // 2
            root = _forest(group, cross, side, start, fp.view(np.uint64), max_bits)
            own = np.nonzero(root != np.arange(len(root)))[0]
            yield pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(fp[root[own]])], ["a", "b"])

    return (
        dealt.select("group", "key", "cross", "side", "fp")
        .repartition("group").sortWithinPartitions("group").mapInArrow(run, "a long, b long")
    )


def simhash_groups(docs: DataFrame, size: int = 4, max_bits: int = 4, tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document of ``docs`` (columns doc_id, text; others are not read).

    ``fingerprint`` is 16 hex digits. Documents are linked when their fingerprints differ in at most ``max_bits`` bits;
    ``component_id`` is the smallest doc_id reachable by links. A null or empty text has no words: fingerprint zero,
    linked like any other. Repeated rows stay rows. A document without id is linked but never names its component
    unless no member has an id (then null). An empty table gives no rows.
    """
    prints = stored(fingerprints(docs, size), "fingerprints")
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    found = components(links(firsts.select("fp"), max_bits, tile))
    rooted = stored(
        firsts.join(found.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "rooted"
    )
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = stored(rooted.select("fp", "root").join(named, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
