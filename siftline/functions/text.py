"""Text scalars: normal forms, escaping, list splitting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Company suffixes removed from the end of a name, tried in this order.
COMPANY_SUFFIXES = [
    "inc", "llc", "corp", "corporation", "ltd", "limited",
    "co", "company", "group", "technologies", "tech",
    "solutions", "holdings", "enterprises", "services",
]
# Spellings of "no address".
NO_ADDRESS = ["", "null", "none", "n/a"]

# All Unicode white space, as a Java character class. Java's own \s and trim()
# know only the ASCII part of it.
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_NOT_WORD_OR_WS = r"[^\p{L}\p{N}_" + WS[1:]


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def collapse_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+", " ")


def normalize_company(c: Column) -> Column:
    """Lower-case name without legal suffixes, punctuation and extra spaces.

    Each suffix is tried once, in list order, and needs no word boundary.
    """
    bare = reduce(
        lambda name, suffix: F.regexp_replace(name, rf"{suffix}[.,]?{WS}*\z", ""),
        COMPANY_SUFFIXES,
        F.lower(c),
    )
    return F.trim(collapse_ws(F.regexp_replace(bare, _NOT_WORD_OR_WS, "")))


def normalize_title(c: Column) -> Column:
    """Lower-case title, spaces collapsed, then ``.,;:`` removed at both ends."""
    return F.btrim(F.trim(collapse_ws(F.lower(c))), F.lit(".,;:"))


def fingerprint(company: Column, title: Column) -> Column:
    return F.concat_ws("|", normalize_company(company), normalize_title(title))


def parse_address(c: Column) -> Column:
    bare = strip(c)
    return F.when(~F.lower(bare).isin(NO_ADDRESS), bare)


def md_escape(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("&#124;"))


def html_escape(c: Column) -> Column:
    # HTML entities, ampersand first.
    entities = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
    return reduce(lambda s, e: F.replace(s, F.lit(e[0]), F.lit(e[1])), entities, c)


def truncate_text(c: Column, limit: int = 2000) -> Column:
    return F.when(F.length(c) <= limit, c).otherwise(
        F.concat(F.substring(c, 1, limit), F.lit("..."))
    )


def score_band(c: Column) -> Column:
    """Colour of a similarity score: at least 90, at least 80, below."""
    # The three colours.
    return F.when(c >= 90, "#e74c3c").when(c >= 80, "#e67e22").otherwise("#27ae60")


def split_requirements(c: Column, drop_empty: bool = False) -> Column:
    """Items of a ``|``-separated list, trimmed."""
    items = F.transform(F.split(c, r"\|"), strip)
    return F.filter(items, lambda item: item != "") if drop_empty else items
