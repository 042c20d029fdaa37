"""Packing tokenised documents into sequences by bounded-space best fit."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from tokenizers import Tokenizer

from siftline.llm.common import id_in, id_out, parts_for, small_batches, text_in
from siftline.session import materialize

END = 0
SEGMENT = 1 << 19

# The tokenizer's own word rule for texts within Latin-1, after lower-casing: classes of characters by their UTF-8 bytes.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_LETTERS, _DIGITS, _SPACES = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t-\r\x85\xa0"
_ENDINGS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]


def _classes(codes: range) -> np.ndarray:
    kind = lambda c: next((k for k, r in ((_SPACE, _SPACES), (_LETTER, _LETTERS), (_DIGIT, _DIGITS)) if re.match(f"[{r}]", c)), _OTHER)
    return np.array([kind(chr(c)) for c in codes], np.uint8)


_ONE = np.r_[_classes(range(0x80)), np.full(0x80, _OTHER, np.uint8)]
_TWO = _classes(range(0x80, 0x100)).reshape(2, 64)  # behind the lead bytes 0xC2 and 0xC3
_GAP = re.compile(rb"[ \t-\r]")

# Byte-level alphabet: printable Latin-1 bytes are themselves, the others follow after 255 in order.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_HIDDEN = [b for b in range(0x100) if b not in _SHOWN]
_ALPHABET = {b: chr(b) for b in _SHOWN} | {b: chr(0x100 + i) for i, b in enumerate(_HIDDEN)}

_VALUE = np.random.default_rng(6).integers(1, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of UTF-8 ``data`` within Latin-1, with a 64-bit hash of each; a zero byte stands between texts."""

    def __init__(self, data: np.ndarray) -> None:
        upper = (data >= 0x41) & (data <= 0x5A)
        self.data = data = np.where(upper, data + 0x20, data).astype(np.uint8)
        cls, first = _ONE[data], np.ones(len(data), bool)
        cls[data == 0] = _SPACE
        lead = np.flatnonzero(data >= 0xC2)
        after = data[lead + 1]
        capital = (data[lead] == 0xC3) & (after <= 0x9E) & (after != 0x97)
        data[lead[capital] + 1] += 0x20
        cls[lead] = cls[lead + 1] = _TWO[data[lead] - 0xC2, data[lead + 1] - 0x80]
        first[lead + 1] = False
        starts = cls != _SPACE
        starts[1:] &= (cls[1:] != cls[:-1]) | ((cls[1:] == _DIGIT) & first[1:])
        self._endings(cls, starts)
        at = np.flatnonzero(cls != _SPACE)
        begin = np.flatnonzero(starts[at])
        size = np.diff(np.r_[begin, len(at)])
        self.start, self.size = at[begin], size
        self.hash = np.zeros(0, np.uint64)
        if len(at):
            powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(int(size.max()) - 1, _BASE)])
            place = np.arange(len(at)) - np.repeat(begin, size)
            self.hash = np.add.reduceat(_VALUE[data[at]] * powers[place], begin) + size.astype(np.uint64)

    def _endings(self, cls: np.ndarray, starts: np.ndarray) -> None:
        """An apostrophe of its own takes the letters of an ending behind it."""
        n = len(self.data)
        at = np.flatnonzero((self.data == 0x27) & starts)
        at = at[at + 1 < n]
        left = np.ones(len(at), bool)
        for ending in _ENDINGS:
            letters = ending[1:].encode()
            fits = left & (at + len(letters) < n)
            for i, letter in enumerate(letters, 1):
                fits &= self.data[np.minimum(at + i, n - 1)] == letter
            left &= ~fits
            starts[at[fits] + 1] = False
            behind = at[fits] + len(ending)
            behind = behind[behind < n]
            starts[behind[cls[behind] == _LETTER]] = True

    def words(self, which: np.ndarray) -> list[str]:
        raw = self.data.tobytes()
        return [raw[a:b].decode() for a, b in zip(self.start[which].tolist(), (self.start + self.size)[which].tolist())]


class WordTokenizer:
    """A byte-level word BPE that tokenises every different word once.

    Words never join in this kind of tokenizer, so the ids of a text are those of
    its words in turn. Texts beyond Latin-1, or with a special token's brackets,
    go through the tokenizer whole. The ids of ``most_words`` words at most are remembered by their hash; then all are forgotten.
    Two different words have one hash of 64 bits, and so one of them wrong ids, about once in 10^13 words.
    """

    def __init__(self, path: str, most_words: int = 1 << 19) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.most_words = most_words
        self._clear()

    def _clear(self) -> None:
        self.keys, self.begin, self.many = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, "<u4")

    def _learn(self, words: Words, hashes: np.ndarray, examples: np.ndarray) -> None:
        tokenize, found = self.tokenizer.model.tokenize, []
        for w in words.words(examples):
            spelled = w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(_ALPHABET)
            found.append([t.id for t in tokenize(spelled)])
        many = np.array(list(map(len, found)), np.int64)
        begin = len(self.pool) + np.cumsum(many) - many
        at = np.searchsorted(self.keys, hashes)
        self.keys, self.begin, self.many = (np.insert(old, at, new) for old, new in ((self.keys, hashes), (self.begin, begin), (self.many, many)))
        self.pool = np.concatenate([self.pool, np.fromiter((i for f in found for i in f), "<u4", int(many.sum()))])

    def _places(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word begin in the pool, and how many they are."""
        hashes, examples, back = np.unique(words.hash, return_index=True, return_inverse=True)
        known = np.isin(hashes, self.keys, assume_unique=True)
        if len(self.keys) + (~known).sum() > self.most_words:
            self._clear()
            known[:] = False
        self._learn(words, hashes[~known], examples[~known])
        at = np.searchsorted(self.keys, hashes)
        return self.begin[at][back], self.many[at][back]

    def batch(self, texts: list[bytes], with_ids: bool = True) -> tuple[np.ndarray, list[np.ndarray]]:
        """The number of ids of each text, and with ``with_ids`` the ids as little-endian 32-bit numbers."""
        counts, parts = np.zeros(len(texts), np.int64), [[] for _ in texts]
        waiting, size = [], 0

        def flush() -> None:
            words = Words(np.frombuffer(b"\0".join([t for _, t in waiting]), np.uint8))
            begin, many = self._places(words)
            cuts = np.cumsum([0, *[len(t) + 1 for _, t in waiting]])
            upto = np.r_[0, np.cumsum(many)][np.searchsorted(words.start, cuts)]
            ids = self.pool[np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())] if with_ids else None
            for (text, _), a, b in zip(waiting, upto, upto[1:]):
                counts[text] += b - a
                if with_ids:
                    parts[text].append(ids[a:b])
            waiting.clear()

        for i, text in enumerate(texts):
            beyond = not text.isascii() and (np.frombuffer(text, np.uint8) >= 0xC4).any()
            if beyond or b"<|" in text or b"\0" in text:
                ids = np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4")
                counts[i], parts[i] = len(ids), [ids]
                continue
            at = 0
            while at < len(text):  # long texts in segments, cut between words
                cut = _GAP.search(text, at + SEGMENT)
                end = cut.end() if cut else len(text)
                waiting.append((i, text[at:end]))
                size, at = size + end - at, end
                if size >= SEGMENT:
                    flush()
                    size = 0
        if waiting:
            flush()
        return counts, [np.concatenate(p) if p else np.empty(0, "<u4") for p in parts] if with_ids else []

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of ``text``."""
        return self.batch([text.encode()])[1][0].tobytes()


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def token_pieces(
    docs: DataFrame, tokenizer: str, size: int = 2048, with_ids: bool = False, place: Column | None = None
) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32[, ids][, place]) of ``size`` tokens at most, the closing id 0 included.

    ``tokenizer`` is a path that every executor has. A null or empty text has the closing id only. ``place``, a
    number of the document, is handed on to its pieces.
    """
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    schema += ", place bigint" * (place is not None)
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids + [pa.int64()] * (place is not None)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # of the worker's earlier tasks
        tok = _tokenizer(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                _, found = tok.batch(part.column(1).cast(pa.binary()).to_pylist())
                places = zip(part.column(2).to_pylist()) if part.num_columns > 2 else iter([()] * part.num_rows)
                for doc, ids, at_place in zip(part.column(0).to_pylist(), found, places):
                    ids = ids.tobytes() + np.array([END], "<u4").tobytes()
                    for piece, i in enumerate(range(0, len(ids), 4 * size)):
                        cut = ids[i : i + 4 * size]
                        out.append((doc, piece, i // 4, len(cut) // 4, zlib.crc32(cut)) + (cut,) * with_ids + at_place)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    small_batches(docs)
    placed = [place.alias("place")] if place is not None else []
    return docs.select(id_in("doc_id").alias("doc_id"), text_in().alias("text"), *placed).mapInArrow(run, schema)


def token_counts(text: Column, tokenizer: str) -> Column:
    """Tokens of a text as ``token_pieces`` has them, the closing id included."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tok = _tokenizer(tokenizer)
        for batch in batches:
            counts = [tok.batch([t or b"" for t in batch.slice(at, 256).cast(pa.binary()).to_pylist()], False)[0] + 1 for at in range(0, len(batch), 256)]
            yield pa.array(np.concatenate(counts) if counts else [], pa.int64())

    return F.arrow_udf(run, "bigint")(text)


class OpenBins:
    """At most ``most`` open bins; a bit per amount of free space tells which amounts some bin has."""

    def __init__(self, size: int, most: int) -> None:
        self.size, self.most = size, most
        self.clear()

    def clear(self) -> None:
        self.bits, self.open, self.next = 0, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        bin_ = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.open -= 1
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece: the open bin that it leaves the least space in, or a new one."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open == self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_, free = self.next, self.size
            self.next += 1
        left = free - length
        if left:
            stack = self.by_free.setdefault(left, [])
            if not stack:
                self.bits |= 1 << left
            stack.append(bin_)
            self.open += 1
        return bin_, self.size - free


def pack(
    pieces: DataFrame, size: int = 2048, open_bins: int = 1024, part_rows: int = 1 << 16, order: str | None = None
) -> DataFrame:
    """``pieces`` (… length …) with sequence_id and offset: best fit with ``open_bins`` open bins.

    The pieces are dealt to parts of about ``part_rows`` by a hash and each part
    packs its own in hash order, which a rerun repeats. A piece goes to
    the open bin that it fills best; when none has room and all are open, the fullest
    closes. Memory is the open bins. Pieces longer than ``size`` or without
    length are refused. Sequence ids are unique, not dense.

    With ``order``, the name of a number column, parts are ranges of it and are packed in its order, so
    that sequences with rising ids follow it, as far as open bins reach.
    """
    pieces = materialize(pieces, "pieces")
    columns = pieces.columns
    parts = parts_for(pieces.count(), part_rows)
    keys = [F.col(f"`{c}`") for c in columns if c != "ids"]
    dealt = pieces.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.xxhash64(*keys).alias("turn"))
    dealt = dealt.withColumn("part", F.pmod("turn", F.lit(parts)).cast("int"))
    schema = dealt.schema["row"].dataType
    if order is not None:
        ranged = dealt.withColumn("turn", F.col(f"row.`{order}`")).select("row", "turn").repartitionByRange(parts, "turn")
        spread = ranged.withColumn("part", F.spark_partition_id())
    else:
        spread = dealt.repartition(parts, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, now = OpenBins(size, open_bins), None
        for batch in batches:
            rows = batch.column(0)
            sequence, offset = [], []
            for part, length in zip(batch.column(2).to_pylist(), rows.field("length").to_pylist()):
                if part != now:
                    bins.clear()
                    now = part
                if length is None or not 0 < length <= size:
                    raise ValueError(f"a piece of {length} tokens does not fit sequences of {size}")
                bin_, at = bins.place(length)
                sequence.append((part << 40) + bin_)
                offset.append(at)
            arrays = [rows, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "sequence_id", "offset"])

    placed = spread.sortWithinPartitions("part", "turn", "row").mapInArrow(
        run, f"row {schema.simpleString()}, sequence_id bigint, offset bigint"
    )
    return placed.select("row.*", "sequence_id", "offset")


def pack_documents(
    docs: DataFrame, tokenizer: str, size: int = 2048, open_bins: int = 1024, with_ids: bool = False, place: Column | None = None
) -> DataFrame:
    """Pack whole documents: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset per piece.

    Only documents longer than ``size`` tokens are cut. Null and empty texts are
    one closing token; repeated rows are packed each; a null id comes back as
    null; an empty table gives an empty one; other columns are not read. With
    ``place``, a number per document, sequences follow its order.
    """
    pieces = token_pieces(docs, tokenizer, size, with_ids, place)
    packed = pack(pieces, size, open_bins, order=None if place is None else "place").drop("place")
    return packed.withColumn("doc_id", id_out("doc_id"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of every sequence, from pieces packed with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
