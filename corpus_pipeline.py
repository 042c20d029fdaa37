"""The corpus pipeline: documents to packed training sequences, by the operators of ``siftline.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftline.llm.language import Evidence, identify
from siftline.llm.mixing import mix_sources
from siftline.llm.packing import pack_documents, token_counts
from siftline.llm.queries import MAX_BITS, REPEAT_BYTES, REPEAT_LIMIT, SEQUENCE, SHINGLE, TOKENIZER, table
from siftline.llm.simhash import keep_one
from siftline.llm.suffixes import remove_repeats
from siftline.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language, under the language found; the others go."""
    told = identify(docs, Evidence(markup="lang", host="source")).where("kept")
    return told.select(*[
        F.col("language").alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns
    ])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: that with the smallest id."""
    return keep_one(docs, SHINGLE, MAX_BITS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that smaller documents have; broken characters at cuts go too."""
    cleaned = remove_repeats(docs, REPEAT_BYTES, tuple(c for c in docs.columns if c not in ("doc_id", "text")), as_text=True)
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("bigint")}
    return cleaned.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for, each at least once, in the order of the mix."""
    mixed = mix_sources(docs, repeat_limit=REPEAT_LIMIT, tokens=token_counts(F.col("text"), TOKENIZER))
    return mixed.repartitionByRange("block", "turn").sortWithinPartitions("block", "turn").select("doc.*")


def place_in_files(docs: DataFrame) -> Column | None:
    """Where a row stands in the files that Spark wrote one after the other; a hash of the text for other files.

    None if ``docs`` are not read from files.
    """
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return None
    number = lambda pattern: F.regexp_extract("_metadata.file_name", pattern, 1).try_cast("bigint")
    file = F.shiftleft(number(r"^part-(\d+)-"), 40) + F.shiftleft(number(r"-c(\d+)\."), 32)
    return F.coalesce(file + F.col("_metadata.row_index"), F.xxhash64("text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences, which follow the order of the files of ``docs``."""
    return pack_documents(docs, TOKENIZER, SEQUENCE, place=place_in_files(docs))


STAGES: list[tuple[str, Stage]] = [
    ("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mix", mix), ("pack", pack),
]

# Language models, SimHash and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared scratch folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
