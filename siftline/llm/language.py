"""Language identification by fusing evidence from text, markup, address and host."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from siftline.llm.common import small_batches, text_in
from siftline.session import materialize

UNKNOWN = "und"
BUCKETS = 1 << 13


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed three-byte grams of lower-cased texts, and the text each belongs to.

    Grams with an ASCII digit or sign count as gaps, since they tell nothing of a language.
    """
    lowered = pc.utf8_lower(texts.cast(pa.large_string()))
    offsets = np.frombuffer(lowered.buffers()[1], np.int64)[lowered.offset : lowered.offset + len(lowered) + 1]
    values = lowered.buffers()[2]
    data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    letter = (data >= 128) | ((data >= 97) & (data <= 122))
    code = np.where(letter, data, 32).astype(np.uint32)
    if len(code) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gram = (code[:-2] * np.uint32(0x9E3779B1) + code[1:-1] * np.uint32(0x85EBCA6B)) ^ code[2:] * np.uint32(0xC2B2AE35)
    gram = ((gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(lowered)), np.diff(offsets))
    keep = letter[1:-1] & (owner[:-2] == owner[2:])
    return gram[keep], owner[:-2][keep]


@dataclass(frozen=True)
class TextModel:
    """Log probabilities of hashed grams, a row per language and a last one for text of none."""

    languages: tuple[str, ...]
    table: np.ndarray

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(grams per text, log likelihood per text and row)."""
        gram, owner = _grams(texts)
        n = len(texts)
        counts = np.bincount(owner, minlength=n)
        return counts, np.stack([np.bincount(owner, self.table[i][gram], n) for i in range(len(self.table))], axis=1)


def declared(column: Column, languages: tuple[str, ...]) -> Column:
    """A markup language such as "en-GB" as one of ``languages``; null if it is none."""
    code = F.lower(F.regexp_extract(column, r"^\s*([A-Za-z]+)", 1))
    return F.when(code.isin(*languages), code)


def fit_text(df: DataFrame, text: Column, label: Column, languages: tuple[str, ...]) -> TextModel:
    """Gram frequencies per declared language over all rows of ``df``.

    What reaches the driver is a number per language and bucket, whatever the
    number of rows.
    """
    rows = df.select(text.alias("text"), F.array_position(F.array(*[F.lit(x) for x in languages]), label).alias("place")).where("place > 0")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                gram, owner = _grams(part.column(0))
                place = part.column(1).to_numpy() - 1
                held += np.bincount(place[owner] * BUCKETS + gram, minlength=held.size).reshape(held.shape)
        place, gram = np.nonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(place), pa.array(gram), pa.array(held[place, gram])], ["place", "gram", "n"]
        )

    counted = rows.mapInArrow(count, "place bigint, gram bigint, n bigint").groupBy("place", "gram").agg(F.sum("n").alias("n"))
    held = np.full((len(languages) + 1, BUCKETS), 0.5)
    for place, gram, n in counted.collect():
        held[place, gram] += n
    return TextModel(languages, np.log(held / held.sum(axis=1, keepdims=True)))


@dataclass(frozen=True)
class Evidence:
    """What is fused: the columns of a row, and how far each is trusted.

    ``strength`` scales the text's log likelihood, since grams of one text are not independent;
    ``trust`` is the probability that a declared language is right; ``smoothing`` is
    the weight of a wider prior in documents; below ``least`` a language is not assigned.
    """

    text: str = "text"
    markup: str | None = None
    url: str | None = None
    host: str | None = None
    languages: tuple[str, ...] = ("de", "en", "es", "fr")
    strength: float = 0.2
    trust: float = 0.9
    smoothing: float = 20.0
    least: float = 0.5

    def host_column(self) -> Column:
        if self.url:
            return F.lower(F.regexp_extract(F.coalesce(F.col(self.url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))
        return F.coalesce(F.col(self.host), F.lit("")) if self.host else F.lit("")


def _scored(df: DataFrame, e: Evidence, model: TextModel, fields: list[Column]) -> DataFrame:
    """(row struct, n, logs, host, domain, suffix, markup) with the text's log likelihoods."""
    host = e.host_column()
    labels = F.split(host, r"\.")
    # A host's wider levels: its last two labels, and its last label.
    rows = df.select(
        F.struct(*fields).alias("row"), text_in(e.text).alias("text"), host.alias("host"),
        F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("domain"),
        F.when(F.size(labels) > 1, F.element_at(labels, -1)).otherwise("").alias("suffix"),
        (declared(F.col(e.markup), e.languages) if e.markup else F.lit(None).cast("string")).alias("markup"),
    )
    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"])
    schema = schema.add("n", T.LongType()).add("logs", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, logs = model.scores(part.column("text"))
                rest = [part.column(f.name) for f in schema.fields[:-2]]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(n, pa.int64()), pa.array(list(logs), pa.list_(pa.float64()))], schema.names
                )

    return rows.mapInArrow(run, schema)


def _prior(counts: str, own: str, wider: Column, smoothing: float, i: int) -> Column:
    """Smoothed share of language i among the other documents of a level."""
    mine = F.when(F.col("guess") == i, 1.0).otherwise(0.0)
    others = F.greatest(F.col(own) - F.when(F.col("guess") >= 0, 1.0).otherwise(0.0), F.lit(0.0))
    return (F.greatest(F.get(counts, F.lit(i)) - mine, F.lit(0.0)) + smoothing * wider) / (others + smoothing)


def identify(df: DataFrame, e: Evidence, keep: list[str] | None = None) -> DataFrame:
    """``df`` (columns ``keep``, all by default, in struct ``row``) with language, posterior and kept.

    The posterior of a language is proportional to the likelihood of the text's
    grams, of the declared markup language, and the prior of the row's host. The gram
    model is counted from all rows by their declared language. Priors are counted from
    the languages that the texts alone speak for: the host's own share is smoothed towards
    its domain's, that towards the share of its address suffix, and that
    towards all, each without the row itself. One more hypothesis, with the same chance of every gram, stands for text
    of no language: ``und``. Rows are kept if the best hypothesis is a language
    and its posterior reaches ``least``.

    Null and empty texts, null or unknown markup and rows without host only lack that
    evidence. Repeated rows are judged each; ties go to the first of ``languages``; an
    empty table gives an empty one. Counts per host are sums with map-side
    combine, and the driver only sees numbers per language and gram.
    """
    small_batches(df)
    names, count = e.languages, len(e.languages)
    label = declared(F.col(e.markup), names) if e.markup else F.lit(None).cast("string")
    model = fit_text(df, text_in(e.text), label, names)
    narrow = _scored(df, e, model, [F.lit(1).alias("one")]).select("host", "domain", "suffix", *_guess(count))
    votes = [F.sum(F.when(F.col("guess") == i, 1.0).otherwise(0.0)).alias(f"v{i}") for i in range(count)]
    hosts = materialize(
        narrow.groupBy("host", "domain", "suffix").agg(*votes, F.sum((F.col("guess") >= 0).cast("double")).alias("n")), "hosts"
    )

    def level(key: list[str], name: str) -> DataFrame:
        sums = [F.array(*[F.sum(f"v{i}") for i in range(count)]).alias(f"{name}_votes"), F.sum("n").alias(f"{name}_n")]
        return hosts.groupBy(*key).agg(*sums)

    levels = level(["host", "domain", "suffix"], "host").join(level(["domain"], "domain"), "domain").join(level(["suffix"], "suffix"), "suffix")
    everything = hosts.agg(*[F.sum(f"v{i}") for i in range(count)]).first()
    total = sum(x or 0.0 for x in everything)
    shares = [((x or 0.0) + 1.0) / (total + count) for x in everything]

    fields = [F.col(f"`{c}`") for c in (keep if keep is not None else df.columns)]
    rows = _scored(df, e, model, fields)
    rows = rows.select("*", *_guess(count)).join(levels, ["host", "domain", "suffix"])
    logs = []
    for i, name in enumerate(names):
        suffix = _prior("suffix_votes", "suffix_n", F.lit(shares[i]), e.smoothing, i)
        domain = _prior("domain_votes", "domain_n", suffix, e.smoothing, i)
        host = _prior("host_votes", "host_n", domain, e.smoothing, i)
        said = F.when(F.col("markup").isNull(), 0.0).when(F.col("markup") == name, math.log(e.trust))
        said = said.otherwise(math.log((1 - e.trust) / max(1, count - 1)))
        logs.append(F.log(host) + said + F.get("logs", F.lit(i)) * e.strength)
    # Text of no language is as rare as one document in a thousand, and its markup says nothing.
    logs.append(F.lit(math.log(1e-3) - math.log(count)) + F.get("logs", F.lit(count)) * e.strength)
    rows = rows.withColumn("fused", F.array(*logs)).withColumn("top", F.array_max("fused"))
    rows = rows.withColumn("best", F.array_position("fused", F.col("top")))
    whole = F.aggregate(F.zip_with("fused", F.array_repeat("top", count + 1), lambda x, t: F.exp(x - t)), F.lit(0.0), lambda a, x: a + x)
    language = F.element_at(F.array(*[F.lit(x) for x in (*names, UNKNOWN)]), F.col("best").cast("int"))
    rows = rows.select("row", language.alias("language"), (1.0 / whole).alias("posterior"))
    return rows.withColumn("kept", (F.col("language") != UNKNOWN) & (F.col("posterior") >= e.least))


def _guess(count: int) -> list[Column]:
    """The language that the text alone speaks for, -1 for too little text or none."""
    logs = F.slice("logs", 1, count)
    place = (F.array_position(logs, F.array_max(logs)) - 1).cast("int")
    enough = (F.col("n") >= 20) & (F.array_max(logs) > F.element_at("logs", count + 1))
    return [F.when(enough, place).otherwise(-1).alias("guess")]
