"""Indel similarity of strings and its token-sorted and token-set forms.

The indel distance counts the single-character insertions and deletions that
turn one string into the other: ``len(a) + len(b) - 2 * LCS(a, b)``. Spark has
no such function. ``indel_distance`` is a vectorised UDF for strings of any
length, ``indel_distance_native`` stays in the JVM for strings of which one
has at most 62 characters.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, LongType

from siftline.functions.text import WS, strip

_CHECK_EVERY = 64


def _shared_head(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _lcs(a: str, b: str, needed: int = 0) -> int:
    """Length of the longest common subsequence, or -1 once below ``needed``.

    Bit-parallel (Hyyro 2004): bit i of ``row`` is cleared when a[i] extends a
    common subsequence of ``a`` and the part of ``b`` read so far.
    """
    head = _shared_head(a, b)
    a, b = a[head:], b[head:]
    tail = _shared_head(a[::-1], b[::-1])
    if tail:
        a, b = a[:-tail], b[:-tail]
    shared = head + tail
    if len(a) < len(b):
        a, b = b, a
    if shared + len(b) < needed:
        return -1
    if not b:
        return shared
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    # With at most this many edits, the part of b read so far lies within as many more characters of a.
    edits = len(a) + len(b) - 2 * max(needed - shared, 0)
    for done, ch in enumerate(b, 1):
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
        if done % _CHECK_EVERY == 0 and done + edits < len(a):
            reached = done + edits - (row & ((1 << (done + edits)) - 1)).bit_count()
            if shared + reached + len(b) - done < needed:
                return -1
    return shared + len(a) - row.bit_count()


@pandas_udf(LongType())
def _indel_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], int] = {}
    out = []
    for pair in zip(a, b):
        if pair[0] is None or pair[1] is None:
            out.append(None)
            continue
        if pair not in known:
            known[pair] = len(pair[0]) + len(pair[1]) - 2 * _lcs(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="Int64")


@pandas_udf(DoubleType())
def _ratio_floor_udf(a: pd.Series, b: pd.Series, floor: pd.Series) -> pd.Series:
    out = []
    for left, right, least in zip(a, b, floor):
        total = len(left) + len(right)
        if left == right:
            out.append(100.0)
            continue
        # One below the exact bound, so that rounding never rejects a match.
        lcs = _lcs(left, right, int(least * total / 200) - 1)
        out.append(None if lcs < 0 else 100 * (1 - (total - 2 * lcs) / total))
    return pd.Series(out, dtype="float64")


# So marked, a score is computed once; otherwise a filter on it would compute it a second time.
_indel_udf = _indel_udf.asNondeterministic()
_ratio_floor_udf = _ratio_floor_udf.asNondeterministic()


def indel_distance(a: Column, b: Column) -> Column:
    return _indel_udf(a, b)


def indel_distance_native(a: Column, b: Column) -> Column:
    """Same as ``indel_distance`` inside the JVM; the shorter string has at most 62 characters."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    chars = F.filter(F.split(short, ""), lambda ch: ch != "")
    one = F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")

    def mask_of(ch: Column, every: Column) -> Column:
        marks = F.transform(every, lambda x, i: F.when(x == ch, F.call_function("shiftleft", one, i)).otherwise(zero))
        return F.aggregate(marks, zero, lambda acc, m: acc.bitwiseOR(m))

    masks = F.transform(
        F.array(chars),
        lambda every: F.map_from_arrays(
            F.array_distinct(every),
            F.transform(F.array_distinct(every), lambda ch: mask_of(ch, every)),
        ),
    )
    full = F.call_function("shiftleft", one, F.length(short)) - 1

    def step(row: Column, ch: Column, where: Column) -> Column:
        hit = row.bitwiseAND(F.coalesce(F.try_element_at(where, ch), zero))
        return (row + hit).bitwiseOR(row - hit).bitwiseAND(full)

    letters = F.filter(F.split(long, ""), lambda ch: ch != "")
    left_over = F.get(
        F.transform(
            masks,
            lambda where: F.aggregate(letters, full, lambda row, ch: step(row, ch, where)),
        ),
        F.lit(0),
    )
    lcs = F.length(short) - F.bit_count(left_over)
    return (F.length(a) + F.length(b) - 2 * lcs).cast("bigint")


def _ratio(distance: Column, a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(
        100 * (1 - distance / F.nullif(total, F.lit(0)))
    )


def indel_ratio(a: Column, b: Column) -> Column:
    """Similarity 0..100; two empty strings are 100."""
    return _ratio(indel_distance(a, b), a, b)


def indel_ratio_native(a: Column, b: Column) -> Column:
    return _ratio(indel_distance_native(a, b), a, b)


def indel_ratio_at_least(a: Column, b: Column, floor: float) -> Column:
    """``indel_ratio`` where it reaches ``floor``; a pair that cannot reach it may be null."""
    return _ratio_floor_udf(a, b, F.lit(float(floor)))


def token_sort(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(strip(c), f"{WS}+")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return indel_ratio(token_sort(a), token_sort(b))


def _token_set(c: Column) -> Column:
    return F.filter(F.array_distinct(F.split(strip(c), f"{WS}+")), lambda t: t != "")


def token_set_ratio(a: Column, b: Column) -> Column:
    """Similarity of the token sets, with shared tokens set aside.

    0 if a side has no token, 100 if one set holds the other, else the best of
    three ratios over "shared", "shared + only a" and "shared + only b".
    """
    left, right = _token_set(a), _token_set(b)
    joined = lambda tokens: F.array_join(F.array_sort(tokens), " ")
    shared = joined(F.array_intersect(left, right))
    only_a = joined(F.array_except(left, right))
    only_b = joined(F.array_except(right, left))
    s, x, y = F.length(shared), F.length(only_a), F.length(only_b)
    gap = F.when(s > 0, 1).otherwise(0)
    len_a, len_b = s + gap + x, s + gap + y
    whole = 100 - 100 * indel_distance(only_a, only_b) / F.nullif(len_a + len_b, F.lit(0))
    part_a = 100 - 100 * (gap + x) / F.nullif(s + len_a, F.lit(0))
    part_b = 100 - 100 * (gap + y) / F.nullif(s + len_b, F.lit(0))
    return (
        F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0))
        .when((s > 0) & ((x == 0) | (y == 0)), F.lit(100.0))
        .when(s == 0, whole)
        .otherwise(F.greatest(whole, part_a, part_b))
    )


def company_score(a: Column, b: Column) -> Column:
    """Score of two normalized company names."""
    return F.when(a == b, F.lit(100.0)).otherwise(token_set_ratio(a, b))
