"""Prefix trie of conversations: every distinct beginning is a node, with members, children, leaves and tokens saved.

A node is named by a digest of its turns. Conversations of any length are cut into stretches of ``STRETCH`` turns at the
same places; a stretch is digested turn by turn, and whole stretches are digested in the same way as if they were turns. So no
task holds more than a stretch, and a conversation of a billion turns takes six levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattaudit.llm.base import WORD, stored
from wattaudit.llm.rollup import LOCAL, rollup
from wattaudit.operators.lookups import join_counted

STRETCH = 32
#: Conversation ids of which one row of text is made before the members of a node are digested in order.
ID_SPAN = 4_096
ROOT = bytes(16)


def _digest(text: F.Column) -> F.Column:
    """128 bits of a SHA-256, as hex."""
    return F.left(F.sha2(text, 256), F.lit(32))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words): turns numbered from 1 within their conversation.

    Rows are range-sorted, a conversation over as many tasks as its rows fill; the rows of a conversation in earlier ranges are counted per
    range, and only the conversation a range begins with has any.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # ``tie`` parts rows that agree in all, which may be a third of the table.
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.sha2(text, 256).alias("text_sha"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.rand(0).alias("tie"),
    )
    order = [F.asc_nulls_first("turn"), "role", "text_sha", "tie"]
    # Written first: finding the ranges reads the rows twice, and texts should be digested once.
    turns = stored(turns, "digests")
    ranged = stored(turns.repartitionByRange("conv_id", *order).withColumn("range", F.spark_partition_id()), "turns")
    counts = ranged.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("conv_id", "range", F.sum("n").over(earlier).alias("before")).where("before is not null")
    inside = F.row_number().over(Window.partitionBy("range", "conv_id").orderBy(*order))
    return ranged.withColumn("inside", inside).join(F.broadcast(before), ["conv_id", "range"], "left").select(
        "conv_id", (F.col("inside") + F.coalesce("before", F.lit(0))).alias("pos"),
        _digest(F.concat(F.col("role").cast("binary"), F.lit("\0").cast("binary"), F.col("text_sha").cast("binary"))).alias("digest"), "words",
    )


def rebuilt(turns: DataFrame, group: int = 20, shared: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of the first of their group: rows (conv_id, depth, digest, words, n), and (conv_id, n).

    Conversation c takes the first h turns of conversation c - c % group, h = crc32(c) % shared, then its own after its first h.
    """
    c = F.col("conv_id")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("rows")).select(
        "conv_id", "rows", (c - c % group).alias("base"), (F.crc32(c.cast("string").cast("binary")) % shared).alias("h")
    )
    heads = turns.where((c % group == 0) & (F.col("pos") < shared)).select(c.alias("base"), "pos", "digest", "words")
    lengths = heads.groupBy("base").agg(F.count(F.lit(1)).alias("n_base"))
    taken = F.least(F.col("h"), F.coalesce("n_base", F.lit(0)))
    sizes = sizes.join(lengths, "base", "left").select(
        "conv_id", "base", "rows", "h", taken.alias("taken"), (taken + F.greatest(F.col("rows") - F.col("h"), F.lit(0))).alias("n")
    )
    sizes = stored(sizes, "conversations")
    lent = sizes.join(heads, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "digest", "words", "n")
    own = join_counted(turns, sizes.select("conv_id", "h", "taken", "n", "rows"), ["conv_id"], "rows", "inner").where("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "digest", "words", "n")
    return lent.unionByName(own), sizes.select("conv_id", "n")


def prefixes(turns: DataFrame, carried: list[str], stretch: int = STRETCH) -> DataFrame:
    """(conv_id, depth, key, parent, <carried>): the name of every beginning and of the one a turn shorter."""
    block = F.expr(f"(depth - 1) div {stretch}")
    rows = F.array_sort(F.collect_list(F.struct("depth", "digest", *carried)))
    blocks = turns.groupBy("conv_id", block.alias("block")).agg(rows.alias("rows"))
    digests = F.transform("rows", lambda r: r["digest"])
    ends = F.transform(F.sequence(F.lit(1), F.size("rows")), lambda i: _digest(F.array_join(F.slice(digests, F.lit(1), i), "")))
    blocks = stored(blocks.select("conv_id", "block", "rows", ends.alias("ends")), "stretches")
    long = blocks.agg(F.max("block")).first()[0]
    if long:
        whole = blocks.where(F.size("rows") == stretch).select("conv_id", (F.col("block") + 1).alias("depth"), F.element_at("ends", -1).alias("digest"))
        earlier = prefixes(whole, [], stretch).select("conv_id", F.col("depth").alias("block"), F.lower(F.hex("key")).alias("before"))
        blocks = blocks.join(earlier, ["conv_id", "block"], "left")
        blocks = blocks.withColumn("ends", F.when(F.col("before").isNull(), F.col("ends")).otherwise(
            F.transform("ends", lambda e: _digest(F.concat("before", e)))
        ))
        # A stretch's first beginning follows the last one of the stretch before.
        last = blocks.where(F.size("rows") == stretch).select("conv_id", (F.col("block") + 1).alias("block"), F.element_at("ends", -1).alias("above"))
        blocks = stored(blocks.join(last, ["conv_id", "block"], "left"), "stretches")
    else:
        blocks = blocks.withColumn("above", F.lit(None).cast("string"))
    each = blocks.select("conv_id", "above", "ends", F.posexplode("rows").alias("i", "r"))
    key = F.get("ends", F.col("i"))
    parent = F.when(F.col("i") > 0, F.get("ends", F.col("i") - 1)).otherwise(F.coalesce("above", F.lit(ROOT.hex())))
    return each.select("conv_id", "r.depth", F.unhex(key).alias("key"), F.unhex(parent).alias("parent"), *[F.col("r")[x].alias(x) for x in carried])


def _ends(members: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the ids of each key, ascending, joined by commas.

    Ids are first joined by spans of ID_SPAN numbers, so that a node where a third of all conversations end takes a row for
    each span; these are then streamed through the digest in order, and nothing is held but its state.
    """
    span = F.expr(f"floor(conv_id / {ID_SPAN})")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    spans = members.groupBy("key", span.alias("span")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != key:
                    if state:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _named(done)
        yield _named([(key, state.hexdigest())] if state else [])

    def _named(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["key", "ends_sha256"])

    ordered = spans.select("key", "span", "ids").repartition("key").sortWithinPartitions("key", "span")
    return ordered.mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = 20, shared: int = 4, local: int = LOCAL, stretch: int = STRETCH) -> DataFrame:
    """One row per distinct beginning of the rebuilt ``conversations`` (conv_id, turn, role, text; others are not read).

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Turns are in order of ``turn``, null first, then role, then the SHA-256 of the text; repeated rows are turns of their own.
    Null role and text are empty. A row without conv_id is in no conversation. The root has depth 0 and every conversation as
    member, those without turns too. An empty table gives no rows.
    """
    turns = stored(ordered_turns(conversations), "ordered")
    rows, sizes = rebuilt(turns, group, shared)
    ways = stored(prefixes(rows, ["words", "n"], stretch), "ways")
    left = F.col("n") - F.col("depth") + 1
    nodes = ways.groupBy("key").agg(
        F.min("conv_id").alias("member"), F.count(F.lit(1)).alias("n_convs"), F.first("depth").alias("depth"),
        F.first("parent").alias("parent"), F.first("words").alias("words"), F.sum(left).alias("mass"),
    )
    root = sizes.agg(
        F.lit(ROOT).alias("key"), F.min("conv_id").alias("member"), F.count(F.lit(1)).alias("n_convs"), F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("words"), (F.sum("n") + F.count(F.lit(1))).alias("mass"),
    ).where("n_convs > 0")
    nodes = stored(nodes.select(root.columns).unionByName(root), "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(children, "key", "left").select("*", F.coalesce("n_children", F.lit(0).cast("long")).alias("n")).drop("n_children").withColumnRenamed("n", "n_children"), "counted")
    tree = nodes.select(
        "key", "parent", "depth", "member", "mass", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    paths = ways.select(F.col("conv_id").alias("member"), "depth", "key", "parent")
    sums = rollup(tree, paths, ["n_leaves", "saved_tokens"], local)
    ending = ways.where("depth = n").select("key", "conv_id").unionByName(sizes.where("n = 0").select(F.lit(ROOT).alias("key"), "conv_id"))
    above = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("member").alias("parent_conv_id"), F.col("n_children").alias("rows"))
    placed = join_counted(nodes.where("parent is not null"), above, ["parent"], "rows", "inner").unionByName(
        nodes.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    )
    return placed.join(sums, "key").join(_ends(ending), "key", "left").select(
        F.col("member").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


_CRC = ("xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),"
        " lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295)")
TRIE_SQL = rf"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS p,
                  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, t.p, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.p <= c.h
      UNION ALL SELECT c.conv_id, t.p + 1000000, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.p > c.h),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS d,
             concat(role, chr(0), sha256(text)) AS turn, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words FROM b),
l AS (SELECT conv_id, list(sha256(turn) ORDER BY d) AS turns FROM r GROUP BY conv_id),
p AS (SELECT r.conv_id, r.d, sha256(array_to_string(l.turns[1:r.d], '')) AS k,
             CASE WHEN r.d > 1 THEN sha256(array_to_string(l.turns[1:r.d - 1], '')) ELSE '' END AS up, r.words, len(l.turns) AS n
      FROM r JOIN l ON r.conv_id = l.conv_id
      UNION ALL SELECT c.conv_id, 0, '', NULL, 0, coalesce(len(l.turns), 0) FROM c LEFT JOIN l ON c.conv_id = l.conv_id),
v AS (SELECT k, min(conv_id) AS conv_id, any_value(d) AS d, any_value(up) AS up, count(*) AS n_convs, any_value(words) AS words,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = n), '')) AS ends_sha256
      FROM p GROUP BY k),
n AS (SELECT up AS k, count(*) AS n_children FROM v WHERE up IS NOT NULL GROUP BY up),
w AS (SELECT v.*, coalesce(n.n_children, 0) AS n_children FROM v LEFT JOIN n ON v.k = n.k),
a AS (SELECT q.k, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((w.n_convs - 1) * w.words) AS saved_tokens
      FROM (SELECT DISTINCT x.k, y.k AS under FROM p x JOIN p y ON x.conv_id = y.conv_id AND y.d >= x.d) q JOIN w ON q.under = w.k GROUP BY q.k)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children,
       CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN a ON w.k = a.k LEFT JOIN w u ON w.up = u.k
"""
