"""Age of a listing in days, from the relative age texts of the boards."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siftline.functions.text import strip

# Days per unit in both spellings, as (times, divided by).
LONG_UNITS = {"hour": (1, 24), "day": (1, 1), "week": (7, 1), "month": (30, 1)}
SHORT_UNITS = {"mo": (30, 1), "d": (1, 1), "w": (7, 1), "h": (1, 24)}


def _in_days(number: Column, unit: Column, per_unit: dict[str, tuple[int, int]]) -> Column:
    lookup = lambda i: F.try_element_at(
        F.create_map(*[F.lit(x) for name, factor in per_unit.items() for x in (name, float(factor[i]))]), unit
    )
    return number.try_cast("double") * lookup(0) / lookup(1)


def age_days(c: Column, dialect: str) -> Column:
    """Days as a double, null where the text states no age.

    ``long``: a number and hour/day/week/month anywhere in the text.
    ``today``: like ``long``, but "just posted" and "today" are 0.
    ``short``: a leading number with mo/d/w/h.
    """
    if dialect == "short":
        pattern, text = r"(?U)\A(\d+)\s*(mo|d|w|h)", F.lower(strip(c))
        units = SHORT_UNITS
    elif dialect in ("long", "today"):
        pattern, text = r"(?iU)(\d+)\s+(hour|day|week|month)", c
        units = LONG_UNITS
    else:
        raise ValueError(f"unknown age dialect: {dialect}")
    parsed = _in_days(
        F.regexp_extract(text, pattern, 1), F.lower(F.regexp_extract(text, pattern, 2)), units
    )
    if dialect == "today":
        low = F.lower(c)
        fresh = F.contains(low, F.lit("just posted")) | F.contains(low, F.lit("today"))
        return F.when(fresh, F.lit(0.0)).otherwise(parsed)
    return parsed
