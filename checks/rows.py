"""Queries over filters, key dedup, ranking, reports and locations."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, functions as F

from checks import sqltext as S
from checks.registry import query
from checks.tables import Tables
from siftline.operators import locate, numbering, prefilter as pre, ranking, report
from siftline.session import scratch_path

c = F.col
SETTINGS = pre.PrefilterSettings(["src3 Inc.", "SRC5", "src7, LLC"], ["Staff", "engineer ii"], True, 20)
RUN_DATE = dt.date(2026, 2, 1)

COMPANY_OUT = "lower(company) IN ('src3 inc.', 'src5', 'src7, llc')"
TITLE_OUT = "(contains(lower(title), 'staff') OR contains(lower(title), 'engineer ii'))"
REPOST = "contains(lower(date_posted), 'reposted')"
SOURCE_AGE = (
    f"CASE source WHEN 'linkedin' THEN {S.age('date_posted', 'long')} WHEN 'indeed' THEN {S.age('date_posted', 'today')} "
    f"WHEN 'hiring_cafe' THEN {S.age('date_posted', 'short')} END"
)
REASONED = (
    f"SELECT *, CASE WHEN {COMPANY_OUT} THEN 'company' WHEN {TITLE_OUT} THEN 'title' "
    f"WHEN source = 'linkedin' AND {REPOST} THEN 'repost' WHEN {SOURCE_AGE} > 20 THEN 'age' ELSE 'kept' END AS drop_reason FROM listings"
)


@query(f"SELECT pos, company FROM listings WHERE NOT ({COMPANY_OUT})")
def exclude_companies(t: Tables) -> DataFrame:
    return pre.exclude_companies(t.listings, SETTINGS.exclude_companies).select("pos", "company")


@query(f"SELECT pos, title FROM listings WHERE NOT {TITLE_OUT}")
def exclude_title_keywords(t: Tables) -> DataFrame:
    return pre.exclude_title_keywords(t.listings, SETTINGS.exclude_title_keywords).select("pos", "title")


@query(f"SELECT pos, date_posted FROM listings WHERE NOT {REPOST}")
def exclude_reposts(t: Tables) -> DataFrame:
    return pre.exclude_reposts(t.listings).select("pos", "date_posted")


@query(
    f"SELECT pos, date_posted FROM (SELECT *, {S.age('date_posted', 'long')} AS age FROM listings) q WHERE age IS NULL OR age <= 10"
)
def max_age(t: Tables) -> DataFrame:
    return pre.max_age(t.listings, 10, "long").select("pos", "date_posted")


@query("SELECT pos, source, title, company, date_posted, description, drop_reason FROM reasoned", reasoned=REASONED)
def prefilter(t: Tables) -> DataFrame:
    kept, dropped = pre.prefilter(t.listings, SETTINGS)
    both = kept.withColumn("drop_reason", F.lit("kept")).unionByName(dropped)
    return both.select("pos", "source", "title", "company", "date_posted", "description", "drop_reason")


@query("SELECT drop_reason, count(*) AS n FROM reasoned GROUP BY drop_reason", reasoned=REASONED)
def prefilter_reasons(t: Tables) -> DataFrame:
    return pre.prefilter_stats(pre.with_drop_reason(t.listings, SETTINGS))


@query(
    """SELECT pos, source, title, coalesce(description, '') AS description FROM cards
 WHERE NOT hidden AND NOT (source <> 'linkedin' AND key = '') AND NOT (source = 'hiring_cafe' AND title = '')
 AND NOT (source IN ('indeed', 'hiring_cafe') AND (description IS NULL OR failed)) AND NOT (source = 'remotive' AND failed)"""
)
def require_fields(t: Tables) -> DataFrame:
    return pre.require_fields(t.cards).select("pos", "source", "title", "description")


@query("SELECT pos, page, key, title FROM cards QUALIFY row_number() OVER (PARTITION BY page, key ORDER BY pos) = 1")
def dedup_within_page(t: Tables) -> DataFrame:
    return pre.dedup_within_page(t.cards).select("pos", "page", "key", "title")


@query("SELECT pos, page, key, title FROM cards QUALIFY page = min(page) OVER (PARTITION BY key)")
def dedup_across_groups(t: Tables) -> DataFrame:
    return pre.dedup_across_groups(t.cards).select("pos", "page", "key", "title")


@query("SELECT pos, page, source, title, company FROM listings")
def union_pages(t: Tables) -> DataFrame:
    """The boards' pages put together again."""
    names = ["linkedin", "indeed", "hiring_cafe", "remotive"]
    return pre.union_pages(*[t.listings.where(c("source") == n) for n in names]).select(
        "pos", "page", "source", "title", "company"
    )


@query("SELECT source, pos, row_number() OVER (ORDER BY source, pos) - 1 AS job_id FROM listings")
def assign_pos(t: Tables) -> DataFrame:
    return numbering.assign_pos(t.listings, page="source").select("source", "pos", "job_id")


@query("SELECT pos, row_number() OVER (ORDER BY page, pos) - 1 AS job_id FROM listings")
def assign_pos_by_page(t: Tables) -> DataFrame:
    return numbering.assign_pos(t.listings).select("pos", "job_id")


# --- ranking and reports

TIERED = {
    "tiered": """SELECT *, CAST(1 + pos % 3 AS INT) AS location_tier,
 CASE pos % 3 WHEN 2 THEN 'no address' ELSE concat(pos % 7, '.5 km from ', company) END AS location_note
 FROM results WHERE result_type = 'scored'""",
    "ranked": "SELECT *, row_number() OVER (ORDER BY location_tier, score DESC, pos) AS rank FROM tiered",
    "headed": """SELECT *, CASE WHEN lag(location_tier) OVER (ORDER BY rank) IS DISTINCT FROM location_tier THEN
 CASE location_tier WHEN 1 THEN 'Tier 1 — Within a configured location radius' WHEN 2 THEN 'Tier 2 — Address found, outside all radii'
 ELSE 'Tier 3 — No address determined' END END AS heading FROM ranked""",
}


def tiered(t: Tables) -> DataFrame:
    m = c("pos") % 3
    note = F.when(m == 2, "no address").otherwise(F.concat((c("pos") % 7).cast("string"), F.lit(".5 km from "), c("company")))
    scored = ranking.split_results(t.results)[0]
    return scored.withColumn("location_tier", (1 + m).cast("int")).withColumn("location_note", note)


@query("SELECT pos, score, row_number() OVER (ORDER BY score DESC, pos) AS rank FROM results WHERE result_type = 'scored'")
def rank_by_score(t: Tables) -> DataFrame:
    return ranking.rank_by_score(ranking.split_results(t.results)[0]).select("pos", "score", "rank")


@query("SELECT pos, location_tier, score, rank FROM ranked", **TIERED)
def rank_by_tier(t: Tables) -> DataFrame:
    return ranking.rank_by_tier(tiered(t)).select("pos", "location_tier", "score", "rank")


@query("SELECT pos, rank, heading FROM headed", **TIERED)
def tier_breaks(t: Tables) -> DataFrame:
    return ranking.tier_breaks(ranking.rank_by_tier(tiered(t))).select("pos", "rank", "heading")


@query(
    "SELECT rank, heading, title, company, url, score, requirements_match, domain_match, location_tier, location_note, "
    "(SELECT coalesce(bool_or(location_tier IS NOT NULL), false) FROM tiered) AS has_tiers FROM headed",
    **TIERED,
)
def ranked_report(t: Tables) -> DataFrame:
    scored = tiered(t)
    return report.ranked_report(scored).select(
        "rank", "heading", "title", "company", "url", "score", "requirements_match", "domain_match",
        "location_tier", "location_note", ranking.has_tiers(scored).alias("has_tiers"),
    )


_ITEMS = "array_to_string(list_transform(string_split({0}, '|'), lambda x: trim(x)), chr(10))"


@query(
    f"""SELECT rank, concat(CASE WHEN heading IS NULL THEN '' ELSE concat(chr(10), '# ', heading, chr(10), chr(10)) END,
 '---', chr(10), chr(10), '| # | Title | Fit | Link |', chr(10), '|---|-------|-----|------|', chr(10),
 '| ', rank, ' | ', replace(title, '|', '&#124;'), ' at ', replace(company, '|', '&#124;'), ' | ', score, '/100 | [View](', url, ') |', chr(10),
 chr(10), '**Location:** ', location_note, chr(10),
 chr(10), '**Requirements Match:** ', requirements_match, '/100', chr(10), '**Domain Match:** ', domain_match, '/100', chr(10), chr(10),
 reasoning, chr(10), chr(10), '**Gaps:** ', gaps, chr(10), chr(10),
 '**Hard Requirements:**', chr(10), {_ITEMS.format('hard_requirements')}, chr(10), chr(10),
 '**Preferred Requirements:**', chr(10), {_ITEMS.format('preferred_requirements')}, chr(10)) AS fragment FROM headed""",
    **TIERED,
)
def report_markdown(t: Tables) -> DataFrame:
    return report.render_markdown(report.ranked_report(tiered(t))).select("rank", "fragment")


@query(
    """SELECT value FROM (SELECT concat('# Results: ', count(*) FILTER (result_type = 'scored'), ' scored, ',
 count(*) FILTER (result_type = 'filtered'), ' filtered, ', count(*) FILTER (result_type = 'failed'), ' failed, 0 duplicates removed') AS value FROM results)
 UNION ALL SELECT concat('rank ', rank, ' ', title) FROM ranked""",
    **TIERED,
)
def report_file(t: Tables) -> DataFrame:
    """Lines of a written report that hold the counts and the rows."""
    path = scratch_path(t.spark, "report")
    ranked = report.ranked_report(tiered(t))
    lines = ranked.withColumn("fragment", F.format_string("rank %d %s", "rank", "title"))
    report.write_report(lines, report.report_header(ranking.run_summary(t.results)), path)
    return t.spark.read.text(path).where(c("value") != "")


@query("SELECT result_type, pos, title FROM results")
def status_split(t: Tables) -> DataFrame:
    return pre.union_pages(*ranking.split_results(t.results)).select("result_type", "pos", "title")


@query(
    """SELECT count(*) FILTER (result_type = 'scored') AS scored, count(*) FILTER (result_type = 'filtered') AS filtered,
 count(*) FILTER (result_type = 'failed') AS failed, count(*) FILTER (result_type <> 'failed') AS committed,
 (SELECT count(*) FROM stored) AS duplicates FROM results"""
)
def run_summary(t: Tables) -> DataFrame:
    return ranking.run_summary(t.results, t.stored.agg(F.count("*")).scalar())


@query(
    "SELECT pos, title, score, rank, 'all' AS source, 'default' AS profile, '2026_02_01' AS run_date FROM ranked", **TIERED
)
def run_output(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "output")
    report.write_run(ranking.rank_by_tier(tiered(t)), path, "all", "default", RUN_DATE)
    found = t.spark.read.parquet(path).select("pos", "title", "score", "rank", "source", "profile", "run_date")
    return found.withColumn("run_date", c("run_date").cast("string"))


@query("SELECT pos, title, company FROM reasoned WHERE drop_reason = 'kept'", reasoned=REASONED)
def settings_prefilter(t: Tables) -> DataFrame:
    """The prefilter under settings that come from a folder of files."""
    from siftline.sources.settings import load_settings

    root = scratch_path(t.spark, "settings")
    files = {
        "config.json": json.dumps({"profile": "default", "scorer": "mock"}),
        "profiles/default/prefilter.json": json.dumps({
            "exclude_companies": SETTINGS.exclude_companies,
            "exclude_title_keywords": SETTINGS.exclude_title_keywords,
            "filter_reposts": True,
            "max_age_days": 20,
        }),
        "profiles/default/background.md": "b",
        "profiles/default/rules.md": "r",
        "profiles/default/fit_criteria.md": "f",
    }
    for name, body in files.items():
        t.spark.range(1).select(F.lit(body)).coalesce(1).write.text(f"{root}/{name}")
    kept, _ = pre.prefilter(t.listings, load_settings(t.spark, root).prefilter)
    return kept.select("pos", "title", "company")


# --- locations

ADDRESSED = {
    "found": "SELECT r.*, k.lat, k.lon, k.address IS NOT NULL AS cache_hit FROM results r LEFT JOIN cache k ON k.address = r.address "
    "WHERE r.result_type = 'scored'",
    "distances": f"SELECT f.pos, l.loc_pos, l.name, {S.haversine('f.lat', 'f.lon', 'l.lat', 'l.lon')} AS km, "
    "coalesce(l.radius_km, 2.5) AS radius_km FROM found f CROSS JOIN locations l WHERE f.lat IS NOT NULL",
    "closest": "SELECT pos, arg_min(name, {'k': km, 'p': loc_pos}) AS nearest_name, min(km) AS nearest_km FROM distances GROUP BY pos",
    "matched": "SELECT pos, arg_min(name, {'k': km, 'p': loc_pos}) AS matched_name, min(km) AS matched_km FROM distances WHERE km <= radius_km GROUP BY pos",
}


def _scored(t: Tables) -> DataFrame:
    return ranking.split_results(t.results)[0]


def _located(t: Tables) -> DataFrame:
    return locate.lookup_coords(_scored(t), t.cache).where(c("lat").isNotNull())


@query("SELECT pos, address, round(lat, 6) AS lat, round(lon, 6) AS lon, cache_hit FROM found", **ADDRESSED)
def geocode_lookup(t: Tables) -> DataFrame:
    found = locate.lookup_coords(_scored(t), t.cache)
    return found.select("pos", "address", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "cache_hit")


@query(
    """SELECT DISTINCT address FROM results WHERE result_type = 'scored' AND address IS NOT NULL
 AND address NOT IN (SELECT address FROM cache)"""
)
def geocode_worklist(t: Tables) -> DataFrame:
    return locate.geocode_worklist(_scored(t), t.cache)


@query(
    """SELECT address, round(lat, 6) AS lat, round(lon, 6) AS lon FROM cache WHERE address NOT IN (SELECT s_name FROM supplier)
 AND address NOT IN (SELECT c_name FROM customer WHERE c_mktsegment = 'MACHINERY')
 UNION ALL SELECT s_name, round(s_acctbal / 1000, 6), NULL FROM supplier
 UNION ALL SELECT c_name, 1.5, round(c_acctbal / 1000, 6) FROM customer WHERE c_mktsegment = 'MACHINERY'"""
)
def cache_merge(t: Tables) -> DataFrame:
    """Cache with new answers for suppliers and corrected ones for a market segment."""
    from siftline.sources.store import read_geocode_cache, write_geocode_cache

    new = t.supplier.select(
        c("s_name").alias("address"), F.round(c("s_acctbal") / 1000, 6).alias("lat"), F.lit(None).cast("double").alias("lon")
    )
    changed = t.customer.where(c("c_mktsegment") == "MACHINERY").select(
        c("c_name").alias("address"), F.lit(1.5).alias("lat"), F.round(c("c_acctbal") / 1000, 6).alias("lon")
    )
    path = scratch_path(t.spark, "cache")
    write_geocode_cache(locate.merge_cache(t.cache, new.unionByName(changed)), path)
    merged = read_geocode_cache(t.spark, path)
    return merged.select("address", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("SELECT pos, nearest_name, round(nearest_km, 6) AS nearest_km FROM closest", **ADDRESSED)
def nearest_location(t: Tables) -> DataFrame:
    found = locate.nearest(_located(t), locate.check_locations(t.locations))
    return found.select("pos", "nearest_name", F.round("nearest_km", 6).alias("nearest_km"))


@query("SELECT pos, matched_name, round(matched_km, 6) AS matched_km FROM matched", **ADDRESSED)
def within_radius(t: Tables) -> DataFrame:
    found = locate.within_radius(_located(t), locate.check_locations(t.locations))
    return found.select("pos", "matched_name", F.round("matched_km", 6).alias("matched_km"))


@query(
    """SELECT f.pos, CAST(CASE WHEN f.lat IS NULL THEN 3 WHEN m.pos IS NOT NULL THEN 1 ELSE 2 END AS INT) AS location_tier,
 CASE WHEN f.lat IS NULL THEN 'no address' WHEN m.pos IS NOT NULL THEN printf('%.1f km from %s', matched_km, matched_name)
 ELSE printf('%.1f km from %s (outside radius)', nearest_km, nearest_name) END AS location_note
 FROM found f LEFT JOIN closest k ON k.pos = f.pos LEFT JOIN matched m ON m.pos = f.pos""",
    **ADDRESSED,
)
def assign_tier(t: Tables) -> DataFrame:
    return locate.assign_tier(_scored(t), t.cache, t.locations).select("pos", "location_tier", "location_note")
