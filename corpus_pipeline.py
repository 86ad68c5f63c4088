"""A corpus pipeline of five stages: language, quality, near-duplicates, mixing, encoding.

Each stage is a function (spark, docs, sf_dir) -> DataFrame that works on all its predecessor kept; ``run`` writes every
result to the shared folder and reads it back for the next. All but the last return the columns they were given. Columns
other than doc_id, text, lang and source pass through whatever their names are. Null or empty texts have no letters and go
in the first stage; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattaudit.llm import langid, quality
from wattaudit.llm.base import read, remainder, stored
from wattaudit.llm.bpe import encode
from wattaudit.llm.mixing import with_copies
from wattaudit.llm.queries import BYTE_BPE
from wattaudit.llm.simhash import simhash_groups

LEAST_QUALITY = 0.7


def _free(docs: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``docs`` is called so."""
    while name.lower() in (c.lower() for c in docs.columns):
        name = f"_{name}"
    return name


def _carried(docs: DataFrame, *names: str, **columns: Column) -> DataFrame:
    """The whole row as one column ``_doc``, beside the columns that an operator needs."""
    return docs.select(F.struct("*").alias("_doc"), *names, *[c.alias(n) for n, c in columns.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those that fit no language, as far as the labels of rows not held out tell.

    A text goes whose fit is above the largest of its language; languages that fit alike are no reason to drop it. A
    text that is labelled and in the sample of its language is known, whatever it holds.
    """
    known = remainder("doc_id", 5) != 0
    model = langid.learn(docs, known)
    largest = langid.largest_fits(docs, known, model)
    lang, score, fit = _free(docs, "lang_pred"), _free(docs, "score"), _free(docs, "fit")
    found = langid.predict(docs, model, lang, score, fit)
    fits = F.lit(False)
    for name, most in largest.items():
        fits |= (F.col(lang) == name) & (F.col(fit) <= most)
    return found.where(fits).drop(lang, score, fit)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are not likely to be good, as far as the labels of documents that aren't held out tell."""
    train = remainder("doc_id", 4) != 2
    model = quality.learn(docs.where(train), read(spark, sf_dir, "labels").where(train))
    score, predicted = _free(docs, "score"), _free(docs, "predicted")
    return quality.predict(docs, model, LEAST_QUALITY, score, predicted).where(F.col(predicted) == 1).drop(score, predicted)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, of the document with the smallest id.

    Rows without id count as documents named by their text. Rows that share an id but not a text are documents of their
    own: all stay that are in different groups, and of those in one group the text with the smallest hash. Of equal ids
    and texts the smallest row stays.
    """
    named = F.coalesce(F.col("doc_id").cast("long"), -1 - F.abs(F.shiftright(F.xxhash64("text"), 1)))
    own = F.xxhash64(named, "text")  # a name for each id and text
    groups = simhash_groups(docs.select(own.alias("doc_id"), "text")).select(F.col("doc_id").alias("_own"), "component_id").distinct()
    ids = docs.select(named.alias("_id"), own.alias("_own")).distinct()
    first = groups.join(ids, "_own").groupBy("component_id").agg(F.min(F.struct("_id", "_own")).alias("first"))
    # Names are short hashes: rows whose names agree by chance are told apart by their ids and a long one.
    rows = _carried(docs, _own=own, _id=named, _text=F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    # Ids are looked up by hash: a task that merged would sort whole rows once for the join and once more for the groups.
    rows = rows.join(first.select("first._own").hint("shuffle_hash"), "_own", "left_semi")
    return rows.groupBy("_own", "_id", "_text").agg(F.min("_doc").alias("_doc")).select("_doc.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document appears as often as the mix takes it, or not at all."""
    found = with_copies(_carried(docs, "doc_id", "text", "source"))
    return found.select("_doc", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("_copy")).select("_doc.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row instead of its text, and whether they decode to it."""
    found = encode(docs, BYTE_BPE, check="decodes", drop=True)
    return found.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("mixing", mixed),
    ("encoding", encoded),
]

# Neither trained models nor XXH64 exist in SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
