"""Near-duplicate vectors by p-stable hashing with exact cosine checks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftline.llm.common import id_in, id_out, parts_for
from siftline.llm.components import connected_components
from siftline.session import materialize

SEED = 8
BLOCK = 1024
SMALL = 8


def _collision(distance: float, width: float) -> float:
    """Probability that two points fall into one cell of one projection."""
    x = width / distance
    return math.erf(x / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def table_plan(rows: int, cosine: float, width: float = 2.0, miss: float = 1e-4) -> tuple[int, int]:
    """(projections per table, tables): unrelated rows meet about once a table, a link is missed with ``miss`` at most.

    Random unit vectors are sqrt(2) apart, linked ones sqrt(2 - 2 cosine) at most.
    """
    near, far = _collision(math.sqrt(max(1e-12, 2 - 2 * cosine)), width), _collision(math.sqrt(2), width)
    projections = max(4, math.ceil(math.log(max(2, rows)) / -math.log(far)))
    return projections, max(1, math.ceil(math.log(miss) / math.log1p(-(near**projections))))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _hash_tables(dims: int, projections: int, tables: int, width: float):
    rng = np.random.default_rng(SEED)
    lines = rng.standard_normal((dims, projections * tables))
    shifts = rng.uniform(0, width, projections * tables)
    mixers = rng.integers(1, 2**62, projections, np.int64) | 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cells = np.floor((_matrix(part.column("vec")) @ lines + shifts) / width).astype(np.int64)
                with np.errstate(over="ignore"):
                    keys = (cells.reshape(-1, tables, projections) * mixers).sum(axis=2)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column("cls").to_numpy(), tables)),
                     pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(keys.ravel())],
                    ["cls", "tbl", "cell"],
                )

    return run


def _block_pairs(members: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """``members`` (key, cls, size, vec) with blocks lo and hi, once per pair of blocks a member belongs to.

    Groups are cut into blocks of about BLOCK rows, so a pair of blocks is
    bounded whatever the size of the group; pairs are dealt to tasks by ``part``.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    sized = members.join(counts, key).withColumn("blocks", blocks)
    sized = sized.withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    paired = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select(
        F.col(key).alias("key"), F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"),
        "mine", "cls", "size", "vec",
    )
    rows = counts.agg(F.sum(F.col("n") * F.ceil(F.col("n") / BLOCK))).first()[0] or 0
    parts = parts_for(rows, 8 * BLOCK)
    return paired.withColumn("part", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(parts)).cast("int"))


class _Pairs:
    """The rows of a part, ordered by pair of blocks: small groups all at once, large ones by block."""

    def __init__(self, table: pa.Table, cosine: float) -> None:
        t = table.sort_by([(c, "ascending") for c in ("key", "lo", "hi", "cls")]).combine_chunks()
        self.cosine, self.ids = cosine, t.column("cls").to_numpy()
        self.size, self.mine = t.column("size").to_numpy(), t.column("mine").to_numpy()
        self.vecs = _matrix(t.column("vec").combine_chunks())
        group = np.stack([t.column(c).to_numpy() for c in ("key", "lo", "hi")])
        self.lo, self.hi = group[1], group[2]
        starts = np.flatnonzero(np.r_[True, (group[:, 1:] != group[:, :-1]).any(axis=0)])
        sizes = np.diff(np.r_[starts, len(self.ids)])
        self.large = [(i, i + n) for i, n in zip(starts, sizes) if n > SMALL]
        self.end = np.repeat(np.where(sizes > SMALL, starts, starts + sizes), sizes)

    def small_links(self) -> tuple[np.ndarray, np.ndarray]:
        """Linked rows (i, j) of groups with SMALL rows at most."""
        found = [(np.empty(0, np.int64),) * 2]
        for step in range(1, SMALL):
            i = np.flatnonzero(np.arange(len(self.ids)) + step < self.end)
            i = i[(self.lo[i] == self.hi[i]) | (self.mine[i] != self.mine[i + step])]
            near = np.einsum("ij,ij->i", self.vecs[i], self.vecs[i + step]) >= self.cosine
            found.append((i[near], i[near] + step))
        return tuple(np.concatenate(x) for x in zip(*found))

    def large_blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, rows, linked or not) between the blocks of larger groups."""
        for i, j in self.large:
            here = np.arange(i, j)
            left, right = here[self.mine[i:j] == self.lo[i]], here[self.mine[i:j] == self.hi[i]]
            for a in range(0, len(left), BLOCK):
                for b in range(0, len(right), BLOCK):
                    rows, cols = left[a : a + BLOCK], right[b : b + BLOCK]
                    yield rows, cols, self.vecs[rows] @ self.vecs[cols].T >= self.cosine


def _spanning(cosine: float):
    """Links that span what is linked within a pair of blocks, each checked exactly."""

    def run(table: pa.Table) -> pa.Table:
        pairs = _Pairs(table, cosine)
        ids, label = pairs.ids, np.arange(table.num_rows)
        a, b = pairs.small_links()
        links = [np.stack([ids[a], ids[b]])]
        for rows, cols, near in pairs.large_blocks():
            for row, linked in zip(rows, near):
                others = cols[linked & (label[cols] != label[row])]
                if len(others):
                    labels, first = np.unique(label[others], return_index=True)
                    links.append(np.stack([np.full(len(first), ids[row]), ids[others[first]]]))
                    label[np.isin(label, labels)] = label[row]
        a, b = np.concatenate(links, axis=1)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _degrees(cosine: float):
    """With how many rows each row is linked across a pair of blocks."""

    def run(table: pa.Table) -> pa.Table:
        pairs = _Pairs(table, cosine)
        links = np.zeros(table.num_rows, np.int64)
        a, b = pairs.small_links()
        np.add.at(links, a, pairs.size[b])
        np.add.at(links, b, pairs.size[a])
        for rows, cols, near in pairs.large_blocks():
            links[rows] += (near & (rows[:, None] != cols[None, :])) @ pairs.size[cols]
            if pairs.mine[rows[0]] != pairs.mine[cols[0]]:
                links[cols] += pairs.size[rows] @ near
        cls, of = np.unique(pairs.ids, return_inverse=True)
        total = np.zeros(len(cls), np.int64)
        np.add.at(total, of, links)
        return pa.table({"cls": pa.array(cls), "links": pa.array(total)})

    return run


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as unit vectors; null for those without a direction."""
    for batch in batches:
        lists, vecs = batch.column("vec"), [None] * batch.num_rows
        lengths = np.asarray(lists.value_lengths().fill_null(0))
        for dims in np.unique(lengths[lengths > 0]):
            at = np.flatnonzero(lengths == dims)
            m = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            top = np.abs(m).max(axis=1)
            good = np.isfinite(top) & (top > 0)  # a null component has become NaN
            at, m = at[good], m[good] / top[good, None]
            m = m / np.sqrt((m * m).sum(axis=1))[:, None] + 0.0
            for i, row in zip(at, m):
                vecs[i] = row
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(vecs, pa.list_(pa.float64()))], ["id", "vec"])


def near_vectors(
    vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding",
    width: float = 2.0, miss: float = 1e-4,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row: links are pairs of cosine ``cosine`` or more.

    Vectors that are null, zero or hold null or non-finite components link with
    nothing; vectors of other lengths only meet their own kind. Equal ids and
    repeated rows each give a row; a null id is the smallest and comes back as null;
    an empty table gives an empty one; other columns are not read.

    How: equal vectors fall together first. Unit vectors are projected on random
    lines, shifted and quantised, and vectors with equal cells in a table meet in
    a bucket; the number of tables is such that a pair at the bound is missed with
    probability ``miss``, nearer pairs far less. Within a bucket links are checked exactly and only
    those that span it leave it. Since links never leave a component, the number of
    links is then counted exactly inside each component. Buckets and components of
    any size are split into pairs of blocks, so no task holds a whole group.
    """
    given = vectors.select(id_in(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    rows = materialize(given.mapInArrow(_unit, "id bigint, vec array<double>"), "vectors")
    classes = rows.where("vec is not null").groupBy("vec").agg(F.min("id").alias("cls"), F.count("*").alias("size"))
    classes = materialize(classes.select("cls", "size", "vec"), "classes")
    spark = vectors.sparkSession
    edges = spark.createDataFrame([], "a bigint, b bigint")
    for dims, n in sorted((r[0], r[1]) for r in classes.groupBy(F.size("vec")).count().collect()):
        some = classes.where(F.size("vec") == dims)
        projections, tables = table_plan(n, cosine, width, miss)
        cells = materialize(
            some.mapInArrow(_hash_tables(dims, projections, tables, width), "cls bigint, tbl int, cell bigint"), "cells"
        )
        # Near copies meet in the same company in many tables; one bucket of each company is enough.
        company = [F.bit_xor(F.xxhash64("cls", F.lit(i))).alias(f"x{i}") for i in range(2)]
        buckets = cells.groupBy("tbl", "cell").agg(F.count("*").alias("n"), *company).where("n > 1")
        once = buckets.groupBy("n", "x0", "x1").agg(F.min(F.struct("tbl", "cell")).alias("at"))
        once = once.select("at.*", "n", F.monotonically_increasing_id().alias("bucket"))
        once = materialize(once, "buckets")
        members, counts = cells.join(once.drop("n"), ["tbl", "cell"]).select("bucket", "cls"), once.select("bucket", "n")
        pairs = _block_pairs(members.join(some, "cls"), "bucket", counts)
        edges = edges.union(pairs.groupBy("part").applyInArrow(_spanning(cosine), "a bigint, b bigint"))
    of = materialize(connected_components(edges), "components")
    within = of.join(classes, of.node == classes.cls).select("component", "cls", "size", "vec")
    counts = of.groupBy("component").agg(F.count("*").alias("n"))
    pairs = _block_pairs(within, "component", counts)
    degree = pairs.groupBy("part").applyInArrow(_degrees(cosine), "cls bigint, links bigint")
    degree = degree.groupBy("cls").agg(F.sum("links").alias("links"))
    told = (
        classes.join(of, classes.cls == of.node, "left").join(degree, "cls", "left")
        .select("vec", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("component", "cls").alias("component"))
    )
    linked = rows.where("vec is not null").join(told, "vec").select("id", "links", "component")
    lone = rows.where("vec is null").select("id", F.lit(0).cast("bigint").alias("links"), F.col("id").alias("component"))
    return linked.union(lone).select(
        id_out("id").alias("vec_id"), F.col("links").alias("n_links"), id_out("component").alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )
