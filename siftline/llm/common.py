"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from siftline.session import small_batches  # noqa: F401

# Inside the operators a null id is the smallest id; results turn it back into null.
NO_ID = -(2**63)


def id_in(name: str) -> Column:
    return F.coalesce(F.col(name).cast("bigint"), F.lit(NO_ID))


def id_out(name: str) -> Column:
    return F.when(F.col(name) != F.lit(NO_ID), F.col(name)).alias(name)


def text_in(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def parts_for(total: int, each: int) -> int:
    """How many parts of at most ``each`` make up ``total``."""
    return max(1, math.ceil(total / each))


def total_bytes(df: DataFrame, column: str) -> int:
    return df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0
