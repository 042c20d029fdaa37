"""The registered query of each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline.llm.decontaminate import decontaminate
from siftline.llm.embeddings import near_vectors
from siftline.llm.language import Evidence, identify
from siftline.llm.mixing import mix_sources
from siftline.llm.multiset import edited_fingerprints
from siftline.llm.packing import pack_documents, token_counts
from siftline.llm.quality import score_quality
from siftline.llm.simhash import simhash_groups
from siftline.llm.suffixes import remove_repeats
from siftline.llm.trie import conversation_trie
from siftline.llm.urlfilter import filter_captures, host_of, path_of
from siftline.llm.warc import warc_round_trip
from siftline.llm.whitening import whiten

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SEQUENCE = 2048
REPEAT_LIMIT = 1.25
COSINE = 0.95
REPEAT_BYTES = 50
SHINGLE, MAX_BITS = 3, 2
COMPONENTS = 8
WINDOW, GRAM = 10, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tokens = table(spark, sf_dir, "documents"), token_counts(F.col("text"), TOKENIZER)
    mixed = mix_sources(docs, repeat_limit=REPEAT_LIMIT, tokens=tokens, keep=["doc_id", "source"])
    return mixed.select("doc.doc_id", "doc.source", "copy", "tokens", "start", "block", "turn", "weight")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: lang is what their markup declared, source the host."""
    told = identify(table(spark, sf_dir, "documents"), Evidence(markup="lang", host="source"), ["doc_id", "lang"])
    return told.select("row.doc_id", F.col("row.lang").alias("declared"), "language", "posterior", "kept")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: the language of the html tag, the address, and the text between tags."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.regexp_extract("html", r'<html[^>]*\blang="([^"]*)"', 1).alias("markup"),
        F.regexp_replace("html", r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ").alias("text"),
    )
    told = identify(pages, Evidence(markup="markup", url="url"), ["page_id", "markup"])
    return told.select("row.page_id", F.col("row.markup").alias("declared"), "language", "posterior", "kept")


def op4_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def url_lists(pages: DataFrame) -> DataFrame:
    """Dated list entries: every page names its URL, directory or host on some day, to add or to remove it."""
    host, path, page = host_of(F.col("url")), path_of(F.col("url")), F.col("page_id")
    kind = F.when(page % 8 == 0, "host").when(page % 8 == 1, "domain").when(page % 8 < 4, "prefix").otherwise("url")
    pattern = F.when(page % 8 < 2, host).when(page % 8 < 4, F.concat(host, F.regexp_extract(path, r"^(/[^/]*)", 1)))
    return pages.select(
        F.concat(F.lit("list"), (page % 3).cast("string")).alias("list"), kind.alias("kind"),
        pattern.otherwise(F.concat(host, path)).alias("pattern"), F.when(page % 5 < 2, "remove").otherwise("add").alias("action"),
        F.date_add(F.lit("2024-01-01").cast("date"), (page * 53 % 360).cast("int")).alias("day"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 360).cast("int"))
    return filter_captures(pages.withColumn("day", fetched), url_lists(pages))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, SEQUENCE)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), COSINE)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), REPEAT_BYTES).drop("kept")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), SHINGLE, MAX_BITS)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), COMPONENTS)


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), WINDOW, GRAM)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_warc, op3_language_id, op4_multiset_hash, op5_url_filter, op6_pack, op7_quality,
        op8_near_vectors, op9_suffix_dedup, op10_simhash, op11_conversation_trie, op12_whitening, op13_decontaminate,
        language_of_pages,
    )
}
