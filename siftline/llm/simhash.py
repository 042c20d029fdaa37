"""SimHash near-duplicates through an inverted index of fingerprint bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from siftline.llm.common import id_in, id_out, small_batches, text_in
from siftline.llm.components import connected_components
from siftline.session import materialize

SEED = 42
BYTES = 8


def simhash(text: str, words: int = 3) -> int:
    """64 bits, each set if it is set in over half the shingles' hashes; 0 without words."""
    seq = text.encode("utf-8", "surrogatepass").lower().split()
    if not seq:
        return 0
    if len(seq) <= words:
        return xxhash.xxh64_intdigest(b" ".join(seq), SEED)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(b" ".join(s), SEED) for s in zip(*(seq[i:] for i in range(words)))], "<u8")
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 4096):
        rows = hashes[start : start + 4096].view(np.uint8).reshape(-1, BYTES)
        ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the columns ``keep`` per row of ``docs``; null and blank texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fps = np.array([simhash(t.as_py(), words) for t in part.column(1)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps), *part.columns[2:]], ["doc_id", "fp", *keep])

    small_batches(docs)
    rows = docs.select(id_in("doc_id").alias("doc_id"), text_in().alias("text"), *keep)
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, "doc_id bigint, fp bigint" + kinds)


def _linker(max_bits: int):
    """Links inside one posting list, whose members differ in ``max_bits`` known bytes at most."""

    def link(fps: np.ndarray, free: list[int]) -> np.ndarray:
        flips = np.array([0] + [1 << (8 * byte + bit) for byte in free for bit in range(8)], np.uint64)
        near = (fps[:, None] ^ flips[None, :]).ravel()
        owner = np.repeat(np.arange(len(fps)), len(flips))
        order = np.lexsort((owner, near))
        near, owner = near[order], owner[order]
        first = np.flatnonzero(np.r_[True, near[1:] != near[:-1]])
        size = np.diff(np.r_[first, len(near)])
        # All in a class are one flip or none from its value, so any two differ in two bits at most.
        centre = fps[owner[first]] if max_bits > 1 else near[first]
        a, b = np.repeat(centre, size), fps[owner]
        keep = (a != b) & np.isin(a, fps)
        pairs = np.unique(np.stack([a[keep], b[keep]], axis=1), axis=0)
        bits = np.unpackbits((pairs[:, 0] ^ pairs[:, 1]).view(np.uint8).reshape(-1, BYTES), axis=1).reshape(-1, BYTES, 8)
        shared = (bits.sum(axis=2) == 0).sum(axis=1)
        return pairs[(shared >= BYTES - max_bits) & (bits.sum(axis=(1, 2)) <= max_bits)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty((0, 2), np.uint64)]
            for free, fps in zip(batch.column(0), batch.column(1)):
                found.append(link(fps.values.to_numpy().view(np.uint64), free.values.to_pylist()))
            pairs = np.concatenate(found).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` at ``max_bits`` or fewer differing bits.

    Inverted index by byte position: d differing bits touch d of the 8 bytes at
    most, so a pair shares 8 - d positional bytes at least. Every fingerprint is
    posted under each choice of 8 - d positions with their bytes; two
    fingerprints meet in a list exactly if their tally of shared bytes reaches
    that minimum. A list leaves d bytes free, so it holds 65,536 different
    fingerprints at most whatever the number of documents. Inside a list, members
    that reach a common value by one flip are joined to one of them instead of to
    each other, so the links grow with the members and not with the pairs; the
    tally and the bit distance of each are then verified.
    """
    if not 1 <= max_bits <= 2:
        raise ValueError("max_bits must be 1 or 2")

    def posting(free: tuple[int, ...]) -> Column:
        mask = reduce(lambda m, byte: m & ~(0xFF << (8 * byte)), free, 2**64 - 1)
        signed = mask - 2**64 if mask >= 2**63 else mask
        where = F.array(*[F.lit(byte).cast("tinyint") for byte in free])
        return F.struct(where.alias("free"), F.col("fp").bitwiseAND(F.lit(signed)).alias("bytes"), F.col("fp"))

    posted = fps.select(F.explode(F.array(*[posting(f) for f in combinations(range(BYTES), max_bits)])).alias("p"))
    lists = posted.select("p.*").groupBy("free", "bytes").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    return lists.select("free", "fps").mapInArrow(_linker(max_bits), "a bigint, b bigint").distinct()


def _components(rows: DataFrame, max_bits: int) -> DataFrame:
    """(fp, least, component) per fingerprint of ``rows`` (doc_id, fp); least is its smallest doc_id."""
    known = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = connected_components(links(known, max_bits))
    return known.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )


def simhash_groups(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs`` (doc_id, text).

    The component is the smallest doc_id reachable over fingerprints that differ
    in ``max_bits`` bits at most. Null and blank texts have fingerprint zero and link like
    any other; repeated rows and ids each give a row; a null id counts as the
    smallest and comes back as null; an empty table gives an empty one. Only
    columns doc_id and text are read. Equal fingerprints collapse before they
    are compared, so copies cost one row in the index.
    """
    rows = materialize(fingerprints(docs, words), "fingerprints")
    group = _components(rows, max_bits)
    ids = group.groupBy("component").agg(F.min("least").alias("component_id"))
    of = group.join(ids, "component").select("fp", "component_id")
    return rows.join(of, "fp").select(
        id_out("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), id_out("component_id")
    )


def keep_one(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of ``docs`` per SimHash group: that with the smallest doc_id, of these that with the smallest text.

    Rows of different groups stay, also under one id or without one. Rows meet their group by
    id and SHA-256 of the text, as an id may stand in several groups.
    """
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), id_in("doc_id").alias("doc_id"),
        text_in().alias("text"), F.unhex(F.sha2(text_in().cast("binary"), 256)).alias("digest"),
    )
    rows = materialize(fingerprints(own, words, keep=("digest",)), "fingerprints")
    group = _components(rows, max_bits)
    ids = group.groupBy("component").agg(F.min("least").alias("doc_id"))
    of = group.join(ids, "component").select("fp", "component", "doc_id")
    first = rows.join(of, ["fp", "doc_id"]).select("component", "doc_id", "digest").distinct()
    kept = own.join(first, ["doc_id", "digest"])
    return kept.groupBy("component").agg(F.min_by("row", F.struct("text", F.xxhash64("row"))).alias("row")).select("row.*")
