"""Ranking of scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftline.operators.numbering import number_rows, pos_block

# Headings of the three tiers.
TIER_LABELS = {
    1: "Tier 1 — Within a configured location radius",
    2: "Tier 2 — Address found, outside all radii",
    3: "Tier 3 — No address determined",
}


def rank_by_score(df: DataFrame) -> DataFrame:
    """Add ``rank``: score descending, ties in input order."""
    buckets = [("_score", -F.col("score")), ("_block", pos_block(F.col("pos")))]
    return number_rows(df, buckets, [F.col("pos")], "rank")


def rank_by_tier(df: DataFrame) -> DataFrame:
    """Add ``rank``: tier, then score descending, then input order.

    Without any tier the tiers are all null and the order is that of
    ``rank_by_score``.
    """
    buckets = [
        ("_tier", F.col("location_tier")),
        ("_score", -F.col("score")),
        ("_block", pos_block(F.col("pos"))),
    ]
    return number_rows(df, buckets, [F.col("pos")], "rank")


def tier_label(tier: Column) -> Column:
    label = F.lit(None).cast("string")
    for number, text in TIER_LABELS.items():
        label = F.when(tier == number, text).otherwise(label)
    return label


def tier_breaks(ranked: DataFrame) -> DataFrame:
    """Add ``heading``: the tier's label on its first row, else null.

    The first rank of a tier is a small aggregate, so no global window is needed.
    """
    first = ranked.groupBy("location_tier").agg(F.min("rank").alias("_first"))
    heading = F.when(F.col("rank") == F.col("_first"), tier_label(F.col("location_tier")))
    return (
        ranked.join(first, "location_tier", "left")
        .withColumn("heading", heading)
        .select(*ranked.columns, "heading")
    )


def has_tiers(df: DataFrame) -> Column:
    """Scalar subquery: any tier set?"""
    return F.coalesce(df.agg(F.bool_or(F.col("location_tier").isNotNull())).scalar(), F.lit(False))


def split_results(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scored, filtered and failed rows."""
    return tuple(df.where(F.col("result_type") == kind) for kind in ("scored", "filtered", "failed"))


def run_summary(results: DataFrame, n_duplicates: Column | int = 0) -> DataFrame:
    """One row of counts; ``committed`` is scored plus filtered."""
    duplicates = n_duplicates if isinstance(n_duplicates, Column) else F.lit(n_duplicates)
    kind = F.col("result_type")
    return results.agg(
        F.count_if(kind == "scored").alias("scored"),
        F.count_if(kind == "filtered").alias("filtered"),
        F.count_if(kind == "failed").alias("failed"),
        F.count_if(kind.isin("scored", "filtered")).alias("committed"),
    ).withColumn("duplicates", duplicates.cast("bigint"))
