"""Queries over scalar functions and page extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from checks import sqltext as S
from checks.registry import query
from checks.tables import Tables
from siftline.functions import ages, geo, similarity, text, urls
from siftline.operators.commit import to_store_rows
from siftline.sources import pages as P

import datetime as dt

c = F.col
RUN_DATE = dt.date(2026, 2, 1)


@query("SELECT pos, source, title, company, location, url, date_posted, description FROM listings")
def listings_scan(t: Tables) -> DataFrame:
    """Listings written as files per source, read back source by source."""
    from siftline.operators.prefilter import union_pages
    from siftline.session import scratch_path
    from siftline.sources.listings import read_listings, write_listings

    path = scratch_path(t.spark, "listings")
    write_listings(t.listings, path)
    names = ["linkedin", "indeed", "hiring_cafe", "remotive"]
    return union_pages(*[read_listings(t.spark, name, path) for name in names]).drop("page")


# --- pages

@query(
    """SELECT page_id,
 CASE WHEN page_id % 5 = 0 THEN concat('https://apply.example.com/', page_id) WHEN page_id % 5 = 3 THEN concat('/rel/', page_id) END AS apply_url,
 CASE WHEN page_id % 5 = 0 THEN concat(' Firm ', page_id % 7, ' ') END AS company_name,
 CASE WHEN page_id % 5 = 3 THEN concat('Other ', page_id % 3) END AS enriched_name,
 page_id % 5 = 1 AS embedded_error FROM data_pages"""
)
def page_embedded_json(t: Tables) -> DataFrame:
    found = P.extract_embedded_json(t.data_pages)
    return found.select("page_id", "apply_url", "company_name", "enriched_name", "embedded_error")


@query(
    f"SELECT page_id, {S.strip_text('inner_html')} AS description FROM article",
    article="SELECT page_id, regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) AS inner_html FROM pages",
)
def page_article_text(t: Tables) -> DataFrame:
    return P.extract_container_text(t.pages, "article").select("page_id", "description")


@query(
    """SELECT page_id, element_pos, regexp_extract(el, '\\shref="([^"]*)"', 1) AS href,
 regexp_extract(el, '\\sdata-job-id="([^"]*)"', 1) AS job_id FROM elements""",
    elements="""SELECT page_id, generate_subscripts(els, 1) - 1 AS element_pos, unnest(els) AS el
 FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*>') AS els FROM pages) q""",
)
def page_link_attrs(t: Tables) -> DataFrame:
    found = P.extract_attrs(t.pages, "a", {"href": "href", "job_id": "data-job-id"})
    return found.select("page_id", c("element_pos").cast("bigint").alias("element_pos"), "href", "job_id")


# --- links and labels

@query("SELECT pos, regexp_extract(url, 'currentJobId=([^&]*)', 1) AS job_id FROM listings")
def url_job_id(t: Tables) -> DataFrame:
    return t.listings.select("pos", urls.job_id_from_url(c("url")).alias("job_id"))


@query(
    """SELECT pos, CASE WHEN source = 'remotive' THEN location ELSE
 concat('https://www.linkedin.com/jobs/view/', regexp_extract(url, 'currentJobId=([^&]*)', 1), '/') END AS url FROM listings"""
)
def canonical_url(t: Tables) -> DataFrame:
    raw = F.when(c("source") == "remotive", c("location")).otherwise(c("url"))
    return t.listings.select("pos", urls.canonical_url(urls.job_id_from_url(raw), raw).alias("url"))


@query(
    """SELECT pos, CASE WHEN starts_with(u, 'http') THEN u ELSE concat('https://remotive.com', u) END AS url
 FROM (SELECT pos, CASE WHEN source = 'remotive' THEN concat('/', location) ELSE url END AS u FROM listings) q"""
)
def absolute_url(t: Tables) -> DataFrame:
    raw = F.when(c("source") == "remotive", F.concat(F.lit("/"), "location")).otherwise(c("url"))
    return t.listings.select("pos", urls.absolutize(raw, "https://remotive.com").alias("url"))


@query(
    """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN concat('https://apply.example.com/', page_id) ELSE url END AS strict_url,
 CASE WHEN page_id % 5 = 0 THEN concat('https://apply.example.com/', page_id) WHEN page_id % 5 = 3 THEN concat('/rel/', page_id) ELSE url END AS any_url
 FROM data_pages"""
)
def apply_url(t: Tables) -> DataFrame:
    found = P.extract_embedded_json(t.data_pages)
    return found.select(
        "page_id",
        urls.prefer_apply_url(c("url"), c("apply_url")).alias("strict_url"),
        urls.prefer_apply_url(c("url"), c("apply_url"), absolute_only=False).alias("any_url"),
    )


@query(
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url WHEN page_id % 5 = 0 THEN concat('Firm ', page_id % 7)
 WHEN page_id % 5 = 3 THEN concat('Other ', page_id % 3) ELSE ' ' END AS company FROM data_pages"""
)
def company_fallback(t: Tables) -> DataFrame:
    found = P.extract_embedded_json(t.data_pages)
    own = F.when(c("page_id") % 2 == 0, c("url")).otherwise(" ")
    return found.select(
        "page_id", urls.company_fallback(own, c("company_name"), c("enriched_name")).alias("company")
    )


@query("SELECT pos, title AS label FROM listings")
def strip_affixes(t: Tables) -> DataFrame:
    label = F.concat(F.lit("Dismiss "), c("title"), F.lit(" job"))
    return t.listings.select("pos", urls.strip_affixes(label, "Dismiss ", " job").alias("label"))


@query(
    """SELECT doc_id, coalesce(string_split(text, chr(10))[2], '') AS second, coalesce(string_split(text, chr(10))[3], '') AS third
 FROM documents"""
)
def array_nth(t: Tables) -> DataFrame:
    lines = F.split("text", "\n")
    return t.documents.select(
        "doc_id", urls.nth_or_empty(lines, 1).alias("second"), urls.nth_or_empty(lines, 2).alias("third")
    )


@query("SELECT pos, CASE WHEN date_posted <> '' THEN concat(date_posted, ' ago') ELSE '' END AS label FROM listings")
def age_label(t: Tables) -> DataFrame:
    return t.listings.select("pos", urls.age_label(c("date_posted")).alias("label"))


@query(
    """SELECT pos, company, title, url, 'mock' AS scorer, '2026-02-01' AS first_seen, description, result_type AS scoring_result_type,
 CASE WHEN result_type = 'scored' THEN reasoning ELSE reason END AS result_reason,
 CASE WHEN result_type = 'scored' THEN score ELSE -1 END AS score, requirements_match, domain_match, gaps
 FROM results WHERE result_type <> 'failed'"""
)
def store_rows(t: Tables) -> DataFrame:
    rows = to_store_rows(t.results, "mock", RUN_DATE)
    return rows.withColumn("first_seen", c("first_seen").cast("string"))


# --- text

@query(f"SELECT pos, {S.norm_company('company')} AS norm FROM listings")
def norm_company(t: Tables) -> DataFrame:
    return t.listings.select("pos", text.normalize_company(c("company")).alias("norm"))


@query(f"SELECT pos, {S.norm_title('title')} AS norm, {S.norm_title('description')} AS norm_text FROM listings")
def norm_title(t: Tables) -> DataFrame:
    return t.listings.select(
        "pos",
        text.normalize_title(c("title")).alias("norm"),
        text.normalize_title(c("description")).alias("norm_text"),
    )


@query(f"SELECT pos, concat({S.norm_company('company')}, '|', {S.norm_title('title')}) AS fingerprint FROM listings")
def fingerprint(t: Tables) -> DataFrame:
    return t.listings.select("pos", text.fingerprint(c("company"), c("title")).alias("fingerprint"))


ADJACENT = {
    "adjacent": "SELECT a.pos, lower(a.title) AS ta, lower(b.title) AS tb, lower(a.company) AS ca, lower(b.company) AS cb, "
    "lower(a.url) AS ua, lower(b.url) AS ub FROM listings a JOIN listings b ON b.pos = a.pos + 1"
}


def _adjacent(t: Tables) -> DataFrame:
    """Every listing next to its successor."""
    low = lambda p: [F.lower(f).alias(f[0] + p) for f in ("title", "company", "url")]
    a = t.listings.select("pos", *low("a"))
    b = t.listings.select((c("pos") - 1).alias("pos"), *low("b"))
    return a.join(b, "pos")


@query(f"SELECT pos, {S.ratio('ta', 'tb')} AS title_ratio, {S.ratio('ua', 'ub')} AS url_ratio FROM adjacent", **ADJACENT)
def indel_ratio(t: Tables) -> DataFrame:
    return _adjacent(t).select(
        "pos",
        similarity.indel_ratio_native(c("ta"), c("tb")).alias("title_ratio"),
        similarity.indel_ratio(c("ua"), c("ub")).alias("url_ratio"),
    )


@query(
    f"SELECT pos, {S.ratio('sa', 'sb')} AS token_sort_ratio FROM sorted_titles",
    sorted_titles=f"SELECT pos, {S.token_sort('ta')} AS sa, {S.token_sort('tb')} AS sb FROM adjacent",
    **ADJACENT,
)
def token_sort_ratio(t: Tables) -> DataFrame:
    return _adjacent(t).select("pos", similarity.token_sort_ratio(c("ta"), c("tb")).alias("token_sort_ratio"))


@query("SELECT pos, token_set_ratio FROM token_sets", **S.token_set_ctes("adjacent", "pos", "ta", "tb"), **ADJACENT)
def token_set_ratio(t: Tables) -> DataFrame:
    return _adjacent(t).select("pos", similarity.token_set_ratio(c("ta"), c("tb")).alias("token_set_ratio"))


@query(
    "SELECT n.pos, CASE WHEN n.na = n.nb THEN 100.0::DOUBLE ELSE k.token_set_ratio END AS company_score "
    "FROM normed n JOIN token_sets k ON k.pos = n.pos",
    normed=f"SELECT pos, {S.norm_company('ca')} AS na, {S.norm_company('cb')} AS nb FROM adjacent",
    **S.token_set_ctes("normed", "pos", "na", "nb"),
    **ADJACENT,
)
def company_score(t: Tables) -> DataFrame:
    normed = [text.normalize_company(c(x)) for x in ("ca", "cb")]
    return _adjacent(t).select("pos", similarity.company_score(*normed).alias("company_score"))


def _age(dialect: str, name: str) -> None:
    def build(t: Tables) -> DataFrame:
        return t.listings.select("pos", ages.age_days(c("date_posted"), dialect).alias("age_days"))

    build.__name__ = name
    query(f"SELECT pos, {S.age('date_posted', dialect)} AS age_days FROM listings")(build)


_age("long", "age_days_long")
_age("today", "age_days_today")
_age("short", "age_days_short")


@query(
    f"SELECT a.address, l.name, round({S.haversine('a.lat', 'a.lon', 'l.lat', 'l.lon')}, 6) AS km "
    "FROM cache a JOIN customer k ON k.c_name = a.address JOIN nation n ON n.n_nationkey = k.c_nationkey "
    "JOIN locations l ON l.loc_pos = n.n_regionkey"
)
def haversine_km(t: Tables) -> DataFrame:
    """Distance of every customer from the location of its region."""
    homes = t.cache.join(t.customer, c("address") == c("c_name")).join(t.nation, c("c_nationkey") == c("n_nationkey"))
    places = t.locations.select(c("loc_pos").alias("n_regionkey"), "name", c("lat").alias("lat2"), c("lon").alias("lon2"))
    km = geo.haversine_km(c("lat"), c("lon"), c("lat2"), c("lon2"))
    return homes.join(places, "n_regionkey").select("address", "name", F.round(km, 6).alias("km"))


@query(
    """SELECT pos, CASE WHEN lower(trim(raw)) IN ('', 'null', 'none', 'n/a') THEN NULL ELSE trim(raw) END AS address
 FROM (SELECT pos, CASE pos % 5 WHEN 0 THEN ' N/A ' WHEN 1 THEN 'None' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE concat(' ', location, ' ') END AS raw FROM listings) q"""
)
def parse_address(t: Tables) -> DataFrame:
    m = c("pos") % 5
    raw = F.when(m == 0, " N/A ").when(m == 1, "None").when(m == 2, "").when(m == 4, F.concat(F.lit(" "), "location", F.lit(" ")))
    return t.listings.select("pos", text.parse_address(raw).alias("address"))


@query("SELECT pos, replace(title, '|', '&#124;') AS title FROM listings")
def md_escape(t: Tables) -> DataFrame:
    return t.listings.select("pos", text.md_escape(c("title")).alias("title"))


@query(
    """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS html
 FROM pages"""
)
def html_escape(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.html_escape(c("html")).alias("html"))


@query("SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text ELSE concat(substring(text, 1, 2000), '...') END AS text FROM documents")
def truncate_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.truncate_text(c("text")).alias("text"))


@query("SELECT doc_id, CASE WHEN n_chars >= 90 THEN '#e74c3c' WHEN n_chars >= 80 THEN '#e67e22' ELSE '#27ae60' END AS band FROM documents")
def score_band(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.score_band(c("n_chars")).alias("band"))


@query(
    """SELECT pos, array_to_string(list_transform(string_split(hard_requirements, '|'), lambda x: trim(x)), ';') AS all_items,
 array_to_string(list_filter(list_transform(string_split(hard_requirements, '|'), lambda x: trim(x)), lambda x: x <> ''), ';') AS shown
 FROM results"""
)
def split_requirements(t: Tables) -> DataFrame:
    items = c("hard_requirements")
    return t.results.select(
        "pos",
        F.array_join(text.split_requirements(items), ";").alias("all_items"),
        F.array_join(text.split_requirements(items, drop_empty=True), ";").alias("shown"),
    )


@query(
    """SELECT address, CASE WHEN lat IS NULL THEN 'no address' WHEN lat < 47.7 THEN printf('%.1f km from %s', km, address)
 ELSE concat(printf('%.1f km from %s', km, address), ' (outside radius)') END AS note
 FROM (SELECT address, lat, (lat - 47) * 3.217 AS km FROM cache) q"""
)
def location_note(t: Tables) -> DataFrame:
    tier = F.when(c("lat").isNull(), 3).when(c("lat") < 47.7, 1).otherwise(2)
    note = geo.location_note(tier, (c("lat") - 47) * 3.217, c("address"))
    return t.cache.select("address", note.alias("note"))
