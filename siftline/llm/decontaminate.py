"""Benchmark decontamination by winnowing: shared fingerprints, extended to whole windows of words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from siftline.llm.common import id_in, id_out, small_batches, text_in
from siftline.session import materialize

SEED = 13
SEGMENT = 1 << 22
BITS = 1 << 23

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_VALUE = np.random.default_rng(SEED).integers(1, 2**63, 256, np.uint64) | np.uint64(1)
_BASE, _STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)

_HITS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int32()), ("fp", pa.int64()), ("window", pa.binary())]))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(n - 1, 0), base)])


class Words:
    """The words of some texts that lie one after the other in ``data``, cut at ``offsets``, and a hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data = _LOWER[data]
        inside = _WORD[self.data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        begins[edges] = inside[edges]  # texts touch each other, words don't
        at = np.flatnonzero(inside)
        first = np.flatnonzero(begins[at])
        self.start, sizes = at[first], np.diff(np.r_[first, len(at)])
        self.end = self.start + sizes
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        self.hash = np.zeros(0, np.uint64)
        if len(at):
            place = np.arange(len(at)) - np.repeat(first, sizes)
            self.hash = np.add.reduceat(_VALUE[self.data[at]] * _powers(_BASE, int(sizes.max()))[place], first)

    def __len__(self) -> int:
        return len(self.start)

    def windows(self, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, least hash of its word grams) of every window of ``length`` words inside a text."""
        n = len(self) - length + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        gram = min(gram, length)
        many = len(self) - gram + 1
        grams = reduce(np.add, (self.hash[j : j + many] * p for j, p in enumerate(_powers(_STEP, gram))))
        grams = (grams ^ np.uint64(length)) * _MIX
        grams = (grams ^ (grams >> np.uint64(32))) * _MIX
        least, held, width = grams, 1, length - gram + 1
        while held < width:  # the least of twice as many, or of two that overlap
            step = min(held, width - held)
            least, held = np.minimum(least[:-step], least[step:]), held + step
        at = np.flatnonzero(self.text[:n] == self.text[length - 1 :])
        return at, least[at]

    def digest(self, first: int, length: int) -> bytes:
        words = [self.data[self.start[i] : self.end[i]].tobytes() for i in range(first, first + length)]
        return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _segments(data: np.ndarray, offsets: np.ndarray, most: int, overlap: int) -> Iterator[tuple[int, int, Words, int]]:
    """(first text, texts, words, words of the first text before): pieces of about ``most`` bytes at most.

    A longer text comes in several pieces, cut between words, each with the last ``overlap`` words of the one before.
    """
    at, n = 0, len(offsets) - 1
    while at < n:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        low, high, before = offsets[at], offsets[upto], 0
        while upto == at + 1 and high - low > most:
            cut = low + most
            while cut < high and _WORD[_LOWER[data[cut]]]:
                cut += 1
            words = Words(data[low:cut], np.array([0, cut - low]))
            yield at, 1, words, before
            if len(words) > overlap:
                before += len(words) - overlap
                low += words.start[len(words) - overlap]
            if cut == high:
                break
            if len(words) <= overlap:  # few, huge words: the next piece is longer instead
                most += most
        else:
            yield at, upto - at, Words(data[low:high], np.maximum(offsets[at : upto + 1] - low, 0)), before
        at = upto


def _scan(lengths: list[int], gram: int, bitmap: np.ndarray | None, most: int):
    """Rows (id, key, n_words, hits): the windows of each text whose fingerprint is in ``bitmap`` (all if unset)."""
    longest = max(lengths, default=1)

    def hits_of(words: Words, total: np.ndarray) -> list[tuple[int, int, int, int, bytes]]:
        found = []
        for length in lengths:
            at, fps = words.windows(length, gram)
            if bitmap is not None:
                bit = fps & np.uint64(len(bitmap) * 64 - 1)
                here = (bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
            else:  # an item has windows of one length
                here = np.minimum(total[words.text[at]], longest) == length
            for i, fp in zip(at[here].tolist(), fps[here].view(np.int64).tolist()):
                found.append((int(words.text[i]), i, length, fp, words.digest(i, length)))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n = batch.column(1).cast(pa.large_binary()), batch.num_rows
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            total, hits = np.zeros(n, np.int64), [[] for _ in range(n)]
            for first, many, words, before in _segments(data, offsets, most, longest - 1):
                counts = np.bincount(words.text, minlength=many)
                total[first : first + many] = counts + before
                began = np.cumsum(counts) - counts
                for text, i, length, fp, window in hits_of(words, total[first : first + many]):
                    hits[first + text].append((i - int(began[text]) + before, length, fp, window))
            keys = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:])]
            hits = pa.array([[dict(zip(("start", "length", "fp", "window"), h)) for h in row] for row in hits], _HITS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(total), hits], ["id", "key", "n_words", "hits"])

    return run


def _fingerprints(rows: DataFrame, id_col: str, lengths: list[int], gram: int, bitmap: np.ndarray | None, most: int) -> DataFrame:
    small_batches(rows)
    return rows.select(id_in(id_col).alias("id"), text_in().alias("text")).mapInArrow(
        _scan(lengths, gram, bitmap, most),
        "id bigint, key binary, n_words bigint, hits array<struct<start: bigint, length: int, fp: bigint, window: binary>>",
    )


def _bitmap(fps: DataFrame, bits: int) -> np.ndarray:
    """A bit per fingerprint value modulo ``bits``: of fixed size, whatever the benchmark's."""
    bit = F.col("fp").bitwiseAND(F.lit(bits - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63)).cast("int"))
    words = fps.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return bitmap


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5, bits: int = BITS, segment: int = SEGMENT
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per row of ``docs`` (doc_id, text, …).

    Words are runs of digits, letters and all beyond ASCII, A-Z in lower case. Any ``window``
    consecutive words of a text of ``benchmark`` (item_id, text, …), or all of a shorter one, are a window;
    a document word inside an occurrence of one is hit. n_items counts the items with
    windows that occur, items_sha256 hashes their ids, sorted as strings and comma-joined.

    Winnowing: of each ``gram`` word grams' hashes in a window the least is its fingerprint, so a span
    of ``window`` shared words has the same one on both sides. Documents keep the windows with a
    fingerprint that the benchmark may have, by a bitmap of ``bits`` bits whatever its size; those meet the benchmark's
    on the fingerprint and on all of their words, as a digest of 128 bits. Shorter items have windows of their own length.

    Null and empty texts have no words; ids may repeat or be null, and each row counts on its own: equal
    texts share one search. Items of equal words share their windows; an item without id
    contaminates but is not among the ids. Empty tables give empty results or clean documents; other columns are
    not read. Long texts are read in pieces of about ``segment`` bytes. A window in very many documents is one
    row on the benchmark's side, so its join has no products; items are looked up once per different set of windows.
    """
    items = _fingerprints(benchmark, "item_id", list(range(1, window + 1)), gram, None, segment)
    own = F.filter("hits", lambda h: h["length"] == F.least("n_words", F.lit(window)))
    items = materialize(items.withColumn("hits", own), "items")
    known = items.select(F.explode("hits").alias("h")).select("h.fp", "h.window").distinct()
    known = materialize(known, "windows")
    lengths = sorted(r[0] for r in items.where("n_words > 0").select(F.least("n_words", F.lit(window))).distinct().collect())
    told = materialize(_fingerprints(docs, "doc_id", lengths, gram, _bitmap(known, bits), segment), "words")

    seen = told.where("size(hits) > 0").select("key", F.explode("hits").alias("h")).select("key", "h.*").distinct()
    found = materialize(seen.join(known, ["fp", "window"]).select("key", "start", "length", "window"), "found")
    before = Window.partitionBy("key").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    new = F.greatest(end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))), F.lit(0))
    hit = found.withColumn("new", new).groupBy("key").agg(F.sum("new").alias("n_hit"))

    # Texts with the same windows have the same items; one of them asks.
    sets = found.select("key", "window").distinct().groupBy("key").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("window")).alias("x"), F.bit_xor(F.xxhash64("window", F.lit(1))).alias("y"),
    )
    sets = materialize(sets, "sets")
    asking = sets.groupBy("n", "x", "y").agg(F.min("key").alias("asks"))
    of_words = items.select("id", F.explode("hits").alias("h")).groupBy("h.window", "id").agg(F.lit(1)).select("window", "id")
    asked = asking.join(found.select(F.col("key").alias("asks"), "window").distinct(), "asks")
    named = asked.join(of_words, "window").select("asks", id_out("id")).where("id is not null").distinct()
    listed = F.array_sort(F.collect_list(F.col("id").cast("string")))
    lists = named.groupBy("asks").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"))
    told_sets = sets.join(asking, ["n", "x", "y"]).join(lists, "asks", "left").join(hit, "key").select(
        "key", "n_hit", F.coalesce("n_items", F.lit(0)).alias("n_items"), "items_sha256",
    )

    none = F.sha2(F.lit(""), 256)
    maybe = told.where("size(hits) > 0").select("id", "key", "n_words").join(told_sets, "key", "left")
    clean = told.where("size(hits) = 0").select(
        "id", "n_words", *[F.lit(0).cast("bigint").alias(c) for c in ("n_hit", "n_items")], F.lit(None).cast("string").alias("items_sha256"),
    )
    rows = maybe.select("id", "n_words", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_hit", "n_items")], "items_sha256").union(clean)
    return rows.select(
        id_out("id").alias("doc_id"), "n_words", "n_hit", "n_items", F.coalesce("items_sha256", none).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
