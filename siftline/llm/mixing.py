"""Temperature mixing of sources, realised as budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline.llm.common import id_in, small_batches, text_in
from siftline.session import materialize

SLICE_ROWS = 4096
GRID = 32
ROUNDS = 8


def token_estimate(text: Column) -> Column:
    """About four bytes a token."""
    return F.ceil(F.octet_length(text) / 4).cast("bigint")


@dataclass(frozen=True)
class Mix:
    exponent: float
    budget: float
    total: float


def _measures(shares: DataFrame, exponents: list[float], budget: float | None) -> list[tuple[float, float, float]]:
    """(entropy, highest repetition, budget) per exponent, by one aggregation over the sources.

    Without a given budget, the smallest is meant that takes every source whole once.
    """
    columns = []
    for i, a in enumerate(exponents):
        w = F.pow("share", F.lit(a))
        columns += [
            F.sum(w).alias(f"s{i}"), F.sum(w * F.log("share")).alias(f"l{i}"),
            F.max(w / F.col("share")).alias(f"hi{i}"), F.min(w / F.col("share")).alias(f"lo{i}"), F.max("total").alias(f"t{i}"),
        ]
    row, out = shares.agg(*columns).first(), []
    for i, a in enumerate(exponents):
        s, logs, high, low, total = (row[f"{c}{i}"] for c in ("s", "l", "hi", "lo", "t"))
        most = budget if budget is not None else total * s / low
        out.append((math.log(s) - a * logs / s, high / s * most / total, most))
    return out


def find_exponent(
    sources: DataFrame, repeat_limit: float | None = None, entropy: float | None = None, budget: float | None = None
) -> Mix:
    """The exponent in [0, 1] for ``sources`` (tokens, all above 0).

    With ``repeat_limit``, the smallest exponent, so the flattest mix, at which no source is
    repeated more often; with ``entropy`` (nats), that at which the weights have
    it. Both fall as the exponent rises; targets out of reach give the
    nearer end. Each round asks for a grid of exponents at once, five bisection steps in one pass over the sources.
    """
    if (repeat_limit is None) == (entropy is None):
        raise ValueError("set one of repeat_limit and entropy")
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total:
        return Mix(1.0, 0.0, 0.0)
    shares = sources.select((F.col("tokens") / F.lit(float(total))).alias("share"), F.lit(float(total)).alias("total"))
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        found = _measures(shares, grid, budget)
        met = [r <= repeat_limit if entropy is None else h <= entropy for h, r, _ in found]
        first = met.index(True) if True in met else GRID
        low, high = grid[max(0, first - 1)], grid[first]
        if first == 0:
            low = high
            break
    return Mix(high, _measures(shares, [high], budget)[0][2], float(total))


def mix_sources(
    docs: DataFrame, repeat_limit: float | None = None, entropy: float | None = None, budget: float | None = None,
    block_tokens: int = 1 << 20, seed: int = 1, tokens: Column | None = None, keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` (doc_id, text, source, …) mixed to weights proportional to source tokens ^ exponent.

    ``tokens`` counts the tokens of a row; unset, four bytes of the text are a token.

    Each row of the result has the columns ``keep`` of ``docs`` (all by default) in struct ``doc``, and copy (0, 1, …),
    tokens, start (the tokens of its source before it), block and turn. A source with weight w
    takes w * budget tokens: whole permuted passes as long as they fit, then the start of one
    more, up to the document that reaches the budget. Without ``budget`` the
    budget is the smallest that takes every document once at least. Block k holds the
    k-th share of w * ``block_tokens`` tokens of every source; reading the rows by
    (block, turn) gives the mix.

    A null source is a source; sources without tokens, such as empty texts only, are
    taken once, and documents without tokens go where they fall. Repeated
    rows are documents of their own; an empty table gives an empty one.

    Permutations are sorted hashes. The running totals come from sums over slices
    of about SLICE_ROWS rows of the hash range, added up per source, and a window
    inside each slice, so a source of any size is spread over tasks. Slices beyond
    the budget are left out before the one shuffle that moves the kept columns.
    """
    size = tokens if tokens is not None else token_estimate(text_in())
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (keep if keep is not None else docs.columns)]).alias("doc"),
        # A null source has a key too, so that joins and windows share one partitioning.
        F.coalesce(F.concat(F.lit("of "), F.col("source").cast("string")), F.lit("")).alias("_source"),
        size.alias("tokens"), id_in("doc_id").alias("_id"), F.xxhash64(id_in("doc_id"), F.col("text")).alias("_own"),
    )
    if tokens is not None:  # counted once, as a tokenizer costs more than a copy of the rows
        small_batches(docs)
        rows = materialize(rows, "counted")
    sources = materialize(
        rows.groupBy("_source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "sources"
    )
    mix = find_exponent(sources.where("tokens > 0"), repeat_limit, entropy, budget)
    weight = F.pow(F.col("tokens") / F.lit(mix.total or 1.0), F.lit(mix.exponent))
    weights = sources.withColumn("w", F.when(F.col("tokens") > 0, weight).otherwise(0.0))
    norm = weights.agg(F.sum("w")).first()[0] or 1.0
    plan = weights.select(
        "_source", F.col("tokens").alias("_of"), (F.col("w") / norm).alias("weight"),
        F.ceil(F.col("n") / SLICE_ROWS).alias("_slices"),
        F.greatest(F.round(F.col("w") / norm * mix.budget).cast("bigint"), F.lit(0)).alias("_budget"),
    )
    last = F.when(F.col("_of") > 0, F.ceil(F.col("_budget") / F.col("_of")) - 1).otherwise(0)
    copies = F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0)).cast("int")))
    taken = rows.join(plan, "_source").withColumn("copy", copies)
    taken = taken.withColumn("turn", F.xxhash64(F.lit(seed), "copy", "_own"))
    taken = taken.withColumn("_slice", F.floor((F.col("turn") / 2.0**64 + 0.5) * F.col("_slices")))
    keys = ["_source", "copy", "_slice"]
    order = Window.partitionBy("_source", "copy").orderBy("_slice")
    sums = taken.groupBy(*keys).agg(F.sum("tokens").alias("_held"))
    sums = materialize(sums.select(*keys, (F.sum("_held").over(order) - F.col("_held")).alias("_before")), "slices")
    began = F.col("copy") * F.col("_of") + F.col("_before")
    placed = taken.join(sums, keys).where((began < F.col("_budget")) | (F.col("copy") == 0))
    within = Window.partitionBy(*keys).orderBy("turn", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("start", began + F.sum("tokens").over(within) - F.col("tokens"))
    placed = placed.where("start < _budget or (copy = 0 and (_of = 0 or tokens = 0))")
    share = F.greatest(F.col("weight") * block_tokens, F.lit(1.0))
    return placed.select(
        "doc", "copy", "tokens", "start", F.floor(F.col("start") / share).alias("block"), "turn",
        F.col("weight"), F.lit(mix.exponent).alias("exponent"),
    )
