"""Connected components of an edge table, as rounds of joins and minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftline.session import materialize


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a batch as stars around the smallest node: fewer rows, same components."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        left, right = places[: len(a)], places[len(a) :]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[left], root[right])
            before = root.copy()
            np.minimum.at(root, root[left], low)
            np.minimum.at(root, root[right], low)
            root = root[root]
            if np.array_equal(root, before):
                break
        child = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[root[child]])], ["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Loops and repeated edges are harmless, an empty table gives an empty one.
    Every round replaces the edges by shorter ones to smaller nodes (first from
    larger neighbours, then from smaller ones) and writes them to the shared
    scratch folder, so a lost executor costs one round at most. Both steps are
    minima by node with map-side sums and equi-joins, whose hot nodes Spark splits.
    """
    pairs = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).where("a <> b")
    stars = materialize(pairs.mapInArrow(_forest, "a bigint, b bigint").distinct(), "edges")
    while True:
        roles = stars.select(F.explode(F.array(
            F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
            F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")),
        )).alias("r")).select("r.*")
        unsettled = roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if unsettled.where("up > 1 or (up = 1 and down = 1)").isEmpty():
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(
            F.col("b").alias("a"), F.least("a", "m").alias("b")
        ).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = materialize(small.union(lower.select("a", F.col("m").alias("b"))).distinct(), "edges")
