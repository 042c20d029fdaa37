"""Consecutive numbers in a global order, without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline.session import materialize

# Rows per block of positions: one window task sorts at most this many rows.
BLOCK = 1 << 20


def pos_block(pos: Column, rows: int = BLOCK) -> Column:
    return F.floor(pos / rows).cast("bigint")


def number_rows(
    df: DataFrame,
    buckets: Sequence[tuple[str, Column]],
    within: Sequence[Column],
    out: str,
    per: Sequence[str] = (),
    many: bool = False,
) -> DataFrame:
    """Add ``out`` = 1, 2, 3, … in the order of the buckets, then of ``within``.

    ``buckets`` are (name, expression) pairs that split the order into
    consecutive parts, ascending, each small enough for one task. The rows of
    every bucket are counted, the counts are summed up to offsets, and rows are
    numbered inside their bucket only. With ``per`` the numbers start again
    for every value of those columns. ``many`` says that the number of buckets grows
    with the rows: their counts are then summed in ranges first, each in a task of
    its own, and only the sums of the ranges in one.
    """
    names = [name for name, _ in buckets]
    bucketed = df.select("*", *[expr.alias(name) for name, expr in buckets])
    keys = [*per, *names]
    counts = bucketed.groupBy(*keys).agg(F.count("*").alias("_rows"))
    ranges = []
    if many:
        # Written, so that all readers see the same ranges.
        ranges = ["_range"]
        counts = materialize(
            counts.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "counts"
        )
        earlier = Window.partitionBy(*per).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        sums = counts.groupBy(*per, "_range").agg(F.sum("_rows").alias("_held"))
        skipped = sums.select(
            *[F.col(k).alias(f"_s_{k}") for k in (*per, "_range")],
            F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_skipped"),
        )
        counts = counts.join(skipped, [counts[k].eqNullSafe(skipped[f"_s_{k}"]) for k in (*per, "_range")])
    else:
        counts = counts.withColumn("_skipped", F.lit(0))
    before = Window.partitionBy(*per, *ranges).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        (F.col("_skipped") + F.coalesce(F.sum("_rows").over(before), F.lit(0))).alias("_before"),
    )
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*within))
    numbered = bucketed.withColumn("_local", local)
    same = [numbered[k].eqNullSafe(offsets[f"_o_{k}"]) for k in keys]
    return numbered.join(offsets, same).select(
        *df.columns, (F.col("_before") + F.col("_local")).cast("bigint").alias(out)
    )


def assign_pos(df: DataFrame, page: str = "page", order: str = "pos", out: str = "job_id") -> DataFrame:
    """Dense positions 0, 1, 2, … in (page, position) order."""
    numbered = number_rows(
        df, [("_page", F.col(page)), ("_block", pos_block(F.col(order)))], [F.col(order)], out, many=True
    )
    return numbered.withColumn(out, F.col(out) - 1)
