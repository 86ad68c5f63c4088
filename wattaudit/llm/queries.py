"""One query for each corpus operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattaudit.llm import langid, language_model, page_text, quality
from wattaudit.llm.base import read, remainder
from wattaudit.llm.bpe import round_trip
from wattaudit.llm.clustering import cluster
from wattaudit.llm.decontaminate import contaminated
from wattaudit.llm.embeddings import near_vectors
from wattaudit.llm.mixing import mix
from wattaudit.llm.search import top_k
from wattaudit.llm.simhash import simhash_groups
from wattaudit.llm.trie import prefix_trie
from wattaudit.llm.warc import read_warc, write_warc
from wattaudit.session import work_dir

#: Vocabulary file of the public tokenizer that op5 and the pipeline use.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned without the rows that are held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 4) == 2
    model = quality.learn(docs.where(~held_out), read(spark, sf_dir, "labels").where(~held_out))
    return quality.predict(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back."""
    folder = work_dir(spark, "warc")
    write_warc(read(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document, by a model of those that aren't held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 7) == 2
    model, counts = language_model.train(docs.where(~held_out))
    return language_model.score(docs, model, counts, {"doc_id": F.col("doc_id"), "held_out": held_out})


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text decoded from them, as digests."""
    return round_trip(read(spark, sf_dir, "documents"), BYTE_BPE, "doc_id")


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = page_text.main_text(pages, page_text.learn(pages))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned without the rows that are held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder("doc_id", 5) == 0
    model = langid.learn(docs, ~held_out)
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def op10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 50, itself included."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return top_k(docs, docs.where(F.col("doc_id") % 50 == 0), k=10)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold windows of which test items."""
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_vectors": op1_near_vectors,
    "op2_quality": op2_quality,
    "op3_warc": op3_warc,
    "op4_language_model": op4_language_model,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_simhash_groups": op6_simhash_groups,
    "op7_main_text": op7_main_text,
    "op8_language": op8_language,
    "op9_mix_sources": op9_mix_sources,
    "op10_search": op10_search,
    "op11_decontamination": op11_decontamination,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_centroids": op13_centroids,
}
