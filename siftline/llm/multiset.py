"""Homomorphic fingerprints of documents as multisets of paragraphs, in Column functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline.llm.common import id_in, id_out, parts_for, text_in
from siftline.session import materialize

# Every lane is a sum modulo 2^60, so adding two of them stays within a long.
POWER = 60
MASK = 2**POWER - 1
DENSE = 4
FIELD = 20
FIELD_MASK = 2**FIELD - 1
TAKEN = 1 | 1 << FIELD | 1 << 2 * FIELD
VIEWS = 2
LANES = 1 + DENSE + VIEWS * FIELD
BUCKET_ROWS, MOST_BUCKETS, START_CHARS = 8192, 1 << 14, 32
# A paragraph ends with its line, or with a sentence, as many texts have one line only.
PARAGRAPH_END = r"[\r\n]+|(?<=[.!?])[ \t]+"


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(text, PARAGRAPH_END), F.trim), lambda p: p != "")


def _salted(salt: int):
    return lambda h: F.xxhash64(h, F.lit(salt))


def _bits(shift: int, mask: int):
    return lambda x: F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(mask))


def _total(hashes: Column, lane) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda acc, h: (acc + lane(h)).bitwiseAND(F.lit(MASK)))


def with_lanes(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``, the fingerprint lanes of column ``text``: array<bigint> of LANES sums modulo 2^60.

    Lane 0 counts paragraphs, the next DENSE sum whole hashes, and the others hold
    three fields of 20 bits each, which count the paragraphs that have a bit of
    their hash set. All are sums over paragraphs, so the order of paragraphs does
    not matter and texts can be joined or parted by adding or subtracting lanes. Beyond 2^20 - 1 paragraphs
    a field runs into the next one: lanes still are equal for equal multisets, but ``likeness`` no longer holds.
    """
    hashed = df.withColumn("_hashes", F.transform(paragraphs(F.col(text)), lambda p: F.xxhash64(p)))
    for k in range(VIEWS):
        hashed = hashed.withColumn(f"_view{k}", F.transform("_hashes", _salted(100 + k)))
    lanes = [F.size("_hashes").cast("bigint")]
    for k in range(DENSE):
        salted = _salted(k)
        lanes.append(_total(F.col("_hashes"), lambda h: salted(h).bitwiseAND(F.lit(MASK))))
    for k in range(VIEWS):
        for j in range(FIELD):
            lanes.append(_total(F.col(f"_view{k}"), _bits(j, TAKEN)))
    return hashed.withColumn(out, F.array(*lanes)).drop("_hashes", *[f"_view{k}" for k in range(VIEWS)])


def insert(lanes: Column, more: Column) -> Column:
    """Lanes of a document with the paragraphs of another added."""
    return F.zip_with(lanes, more, lambda a, b: (a + b).bitwiseAND(F.lit(MASK)))


def delete(lanes: Column, less: Column) -> Column:
    """Lanes of a document with the paragraphs of another taken out."""
    return F.zip_with(lanes, less, lambda a, b: (a - b).bitwiseAND(F.lit(MASK)))


def fingerprint(lanes: Column) -> Column:
    """Lanes as a string."""
    return F.base64(F.unhex(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def signs(lanes: Column) -> Column:
    """Per counted bit: paragraphs with the bit less paragraphs without it."""
    n = F.element_at(lanes, 1)
    packed = F.slice(lanes, 2 + DENSE, VIEWS * FIELD)
    counts = F.concat(*[F.transform(packed, _bits(at, FIELD_MASK)) for at in (0, FIELD, 2 * FIELD)])
    return F.transform(counts, lambda c: (c * 2 - n).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def likeness(a: str, b: str, signs_a: str, signs_b: str) -> Column:
    """Cosine of two fingerprints' signs, 0 to 1; 1 for equal lanes.

    It estimates shared paragraphs over the root of the product of both counts,
    with an error of about 0.09.
    """
    size = F.sqrt(_dot(F.col(signs_a), F.col(signs_a)) * _dot(F.col(signs_b), F.col(signs_b)))
    cosine = F.when(size > 0, _dot(F.col(signs_a), F.col(signs_b)) / size).otherwise(0.0)
    return F.when(F.col(a) == F.col(b), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def with_next(docs: DataFrame, columns: list[str], add=lambda df: df) -> DataFrame:
    """``docs`` (doc_id, text) after ``add``, with next_<column> of the next row by doc_id, then text; after the last comes the first.

    The rows are cut into ranges of (doc_id, start of the text) by sampled bounds, so ids may be anything: hashes, outliers or null.
    Each range also gets the first row of the next, and rows meet their neighbours inside it; ``add`` sees a row only then. A range
    holds about BUCKET_ROWS rows, more beyond MOST_BUCKETS ranges; rows of one id and one start of the text stay together.
    """
    rows = docs.select("doc_id", "text")
    ranges = min(MOST_BUCKETS, parts_for(docs.count(), BUCKET_ROWS))
    rows = rows.repartitionByRange(ranges, "doc_id", F.substring("text", 1, START_CHARS)).withColumn("_bucket", F.spark_partition_id())
    heads = rows.groupBy("_bucket").agg(F.min(F.struct("doc_id", "text")).alias("head"))
    heads = materialize(heads.select("_bucket", "head.*"), "heads")
    order = Window.orderBy("_bucket")  # a row per range
    before = F.coalesce(F.lag("_bucket").over(order), F.max("_bucket").over(Window.partitionBy()))
    before = heads.select("_bucket", before.alias("_before"))
    ahead = heads.join(before, "_bucket").select("doc_id", "text", F.col("_before").alias("_bucket"), F.lit(1).alias("_after"))
    met = rows.withColumn("_after", F.lit(0)).union(ahead)
    met = add(met.repartition("_bucket"))
    window = Window.partitionBy("_bucket").orderBy("_after", "doc_id", "text")
    nexts = [F.lead(c).over(window).alias(f"next_{c}") for c in columns]
    return met.select("*", *nexts).where("_after = 0").drop("_bucket", "_after")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of ``docs`` (doc_id, text) and of each text edited with the next one.

    Edited: the last floor(n_chars / 2) code points are replaced by as many, or all, of
    the first ones of the next row in order of doc_id, then text; after the last comes the first. Returns doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts
    are empty; two empty texts are alike, an empty and another are not. Repeated
    rows follow each other; a null id is the smallest and comes back as null; an
    empty table gives an empty one; other columns are not read; ids may take any 64-bit value but the least. Texts of any length are
    read whole; near_* hold for texts of up to 2^20 - 1 paragraphs.
    """
    rows = docs.select(id_in("doc_id").alias("doc_id"), text_in().alias("text"))
    rows = with_next(rows, ["text", "lanes"], lambda df: with_lanes(df, "text", "lanes"))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("bigint"))
    edited = F.concat(F.expr("substring(text, 1, int(n_chars - n_chars div 2))"), F.expr("substring(next_text, 1, int(n_chars div 2))"))
    rows = rows.select("doc_id", "n_chars", edited.alias("edited"), "lanes", "next_lanes")
    rows = with_lanes(rows, "edited", "edited_lanes")
    names = ("lanes", "edited_lanes", "next_lanes")
    rows = reduce(lambda df, c: df.withColumn(f"{c}_signs", signs(F.col(c))), names, rows)
    return rows.select(
        id_out("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("lanes")).alias("fingerprint"), fingerprint(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness("lanes", "edited_lanes", "lanes_signs", "edited_lanes_signs").alias("near_edited"),
        likeness("lanes", "next_lanes", "lanes_signs", "next_lanes_signs").alias("near_next"),
    )
