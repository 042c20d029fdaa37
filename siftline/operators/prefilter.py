"""Rule filters over listings and the drop reason."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from siftline.functions.ages import age_days
from siftline.sources.listings import POLICIES, SourcePolicy

KEPT = "kept"


@dataclass(frozen=True)
class PrefilterSettings:
    exclude_companies: list[str] = field(default_factory=list)
    exclude_title_keywords: list[str] = field(default_factory=list)
    filter_reposts: bool = False
    max_age_days: float | None = None


def company_excluded(company: Column, names: Sequence[str]) -> Column:
    return F.lower(company).isin([n.lower() for n in names]) if names else F.lit(False)


def title_excluded(title: Column, keywords: Sequence[str]) -> Column:
    """True if any keyword is part of the title; an empty keyword is part of every title."""
    low = F.lower(title)
    hits = [F.contains(low, F.lit(k.lower())) for k in keywords]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def is_repost(date_posted: Column) -> Column:
    return F.contains(F.lower(date_posted), F.lit("reposted"))


def too_old(age: Column, days: float | None) -> Column:
    return F.lit(False) if days is None else F.coalesce(age > F.lit(float(days)), F.lit(False))


def exclude_companies(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.where(~company_excluded(F.col("company"), names))


def exclude_title_keywords(df: DataFrame, keywords: Sequence[str]) -> DataFrame:
    return df.where(~title_excluded(F.col("title"), keywords))


def exclude_reposts(df: DataFrame, enabled: bool = True) -> DataFrame:
    return df.where(~is_repost(F.col("date_posted"))) if enabled else df


def max_age(df: DataFrame, days: float | None, dialect: str) -> DataFrame:
    return df.where(~too_old(age_days(F.col("date_posted"), dialect), days))


def _sources(policies: Sequence[SourcePolicy], applies) -> Column:
    return F.col("source").isin([p.name for p in policies if applies(p)])


def source_age(policies: Sequence[SourcePolicy] = POLICIES) -> Column:
    """Age in days by the dialect of the row's source; null where the source has none."""
    age = F.lit(None).cast("double")
    for dialect in sorted({p.age_dialect for p in policies if p.age_dialect}):
        speaks = _sources(policies, lambda p, d=dialect: p.age_dialect == d)
        age = F.when(speaks, age_days(F.col("date_posted"), dialect)).otherwise(age)
    return age


def with_drop_reason(
    df: DataFrame, settings: PrefilterSettings, policies: Sequence[SourcePolicy] = POLICIES
) -> DataFrame:
    """Add ``drop_reason``: the first rule that drops the row, or "kept"."""
    reason = F.when(
        _sources(policies, lambda p: p.company_rule)
        & company_excluded(F.col("company"), settings.exclude_companies),
        "company",
    ).when(
        _sources(policies, lambda p: p.title_rule)
        & title_excluded(F.col("title"), settings.exclude_title_keywords),
        "title",
    )
    if settings.filter_reposts:
        reason = reason.when(
            _sources(policies, lambda p: p.repost_rule) & is_repost(F.col("date_posted")), "repost"
        )
    reason = reason.when(too_old(source_age(policies), settings.max_age_days), "age")
    return df.withColumn("drop_reason", reason.otherwise(KEPT))


def prefilter(
    df: DataFrame, settings: PrefilterSettings, policies: Sequence[SourcePolicy] = POLICIES
) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and rows that go with their reason."""
    marked = with_drop_reason(df, settings, policies)
    kept = marked.where(F.col("drop_reason") == KEPT).drop("drop_reason")
    return kept, marked.where(F.col("drop_reason") != KEPT)


def prefilter_stats(marked: DataFrame) -> DataFrame:
    return marked.groupBy("drop_reason").agg(F.count("*").alias("n"))


def require_fields(df: DataFrame, policies: Sequence[SourcePolicy] = POLICIES) -> DataFrame:
    """Drop rows without the fields their source needs; fill a missing description.

    Needs ``key``, ``hidden`` (card not shown) and ``failed`` (page not read)
    next to the listing columns; a null description was not found.
    """
    no_key = _sources(policies, lambda p: p.needs_key) & (
        F.coalesce(F.col("key"), F.lit("")) == ""
    )
    no_title = _sources(policies, lambda p: p.needs_title) & (
        F.coalesce(F.col("title"), F.lit("")) == ""
    )
    absent = F.col("description").isNull()
    failed = F.coalesce("failed", F.lit(False))
    no_text = (_sources(policies, lambda p: p.missing_description == "drop") & (absent | failed)) | (
        _sources(policies, lambda p: p.missing_description == "keep_unless_failed") & failed
    )
    kept = df.where(~F.coalesce("hidden", F.lit(False)) & ~no_key & ~no_title & ~no_text)
    return kept.withColumn("description", F.coalesce("description", F.lit("")))


def dedup_within_page(df: DataFrame, key: str = "key") -> DataFrame:
    """The first row by ``pos`` of each key of a page."""
    first = df.groupBy("page", key).agg(F.min("pos").alias("pos"))
    return df.join(first, ["page", key, "pos"], "left_semi")


def dedup_across_groups(df: DataFrame, key: str = "key", group: str = "page") -> DataFrame:
    """Rows whose key was not seen in an earlier group; repeats inside a group stay."""
    first = df.groupBy(key).agg(F.min(group).alias(group))
    return df.join(first, [key, group], "left_semi")


def union_pages(*pages: DataFrame) -> DataFrame:
    """All pages as one table; order is carried by ``page`` and ``pos``."""
    return reduce(lambda a, b: a.unionByName(b), pages)
