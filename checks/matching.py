"""Queries over the fuzzy match against the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from checks import sqltext as S
from checks.registry import query
from checks.tables import Tables
from siftline.operators import dedup as D, report

c = F.col
THRESHOLDS = D.Thresholds(50, 80, 95)


def _keys(source: str, order: str) -> str:
    return (
        f"SELECT {order}, {S.norm_company('company')} AS nc, {S.norm_title('title')} AS nt, lower(description) AS tx FROM {source}"
    )


SCORES = {
    "nk": _keys("listings", "pos"),
    "sk": _keys("stored", "seq"),
    "title_pairs": f"""SELECT *, {S.ratio('na', 'nb')} AS title_score FROM (SELECT a.nt AS ta, b.nt AS tb, {S.token_sort('a.nt')} AS na,
 {S.token_sort('b.nt')} AS nb FROM (SELECT DISTINCT nt FROM nk) a CROSS JOIN (SELECT DISTINCT nt FROM sk) b) q""",
    "company_pairs": "SELECT a.nc AS ca, b.nc AS cb FROM (SELECT DISTINCT nc FROM nk) a CROSS JOIN (SELECT DISTINCT nc FROM sk) b",
    **S.token_set_ctes("company_pairs", "ca, cb", "ca", "cb"),
    "title_scores": "SELECT ta, tb, title_score FROM title_pairs WHERE title_score >= 80",
    "company_scores": """SELECT ca, cb, company_score FROM
 (SELECT ca, cb, CASE WHEN ca = cb THEN 100.0::DOUBLE ELSE token_set_ratio END AS company_score FROM token_sets) q WHERE company_score >= 50""",
}

# Matches of equal whole texts. SQL has no indel distance, and computing it there for whole texts
# takes minutes, so the queries at 95 have no SQL; tests compare them with a nested loop.
EQUAL = {
    **SCORES,
    "firsts": """SELECT k.pos, s.seq, e.company_score, t.title_score, 100.0::DOUBLE AS description_score
 FROM nk k JOIN sk s ON s.tx = k.tx JOIN title_scores t ON t.ta = k.nt AND t.tb = s.nt
 JOIN company_scores e ON e.ca = k.nc AND e.cb = s.nc QUALIFY row_number() OVER (PARTITION BY k.pos ORDER BY s.seq) = 1""",
}
EXACT = D.Thresholds(50, 80, 100)


@query(
    """SELECT a.nc AS n_company, a.nt AS n_title, b.nc AS s_company, b.nt AS s_title, round(company_score, 6) AS company_score,
 round(title_score, 6) AS title_score FROM (SELECT DISTINCT nc, nt FROM nk) a JOIN title_scores t ON t.ta = a.nt
 JOIN (SELECT DISTINCT nc, nt FROM sk) b ON b.nt = t.tb JOIN company_scores e ON e.ca = a.nc AND e.cb = b.nc""",
    **SCORES,
)
def fuzzy_candidates(t: Tables) -> DataFrame:
    found = D.fuzzy_candidates(t.listings, t.stored, THRESHOLDS)
    return found.select(
        "n_company", "n_title", "s_company", "s_title",
        F.round("company_score", 6).alias("company_score"), F.round("title_score", 6).alias("title_score"),
    )


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    scores = [F.round(f"{k}_score", 6).alias(f"{k}_score") for k in ("company", "title", "description")]
    return df.select(*columns, *scores)


def _details(t: Tables, thresholds: D.Thresholds) -> DataFrame:
    return _rounded(
        D.match_details(D.find_matches(t.listings, t.stored, thresholds), t.stored),
        "pos", "matched_company", "matched_title", "matched_description", "matched_url", "matched_first_seen",
    )


@query()
def verify_text(t: Tables) -> DataFrame:
    """Pairs of different whole texts that reach the threshold."""
    new = D.distinct_texts(D.with_keys(t.listings), "pos", "nid")
    stored = D.distinct_texts(D.with_keys(t.stored), "seq", "sid")
    found = D.similar_texts(new, stored, 95)
    return found.select("nid", "sid", F.round("description_score", 6).alias("description_score"))


@query()
def first_match(t: Tables) -> DataFrame:
    return _rounded(D.find_matches(t.listings, t.stored, THRESHOLDS), "pos", "matched_seq")


@query()
def dedup_new(t: Tables) -> DataFrame:
    return D.deduplicate(t.listings, t.stored, THRESHOLDS)[0].select("pos", "title", "company", "description")


@query()
def dedup_matches(t: Tables) -> DataFrame:
    return _details(t, THRESHOLDS)


@query(
    """SELECT pos, seq AS matched_seq, round(company_score, 6) AS company_score, round(title_score, 6) AS title_score,
 round(description_score, 6) AS description_score FROM firsts""",
    **EQUAL,
)
def first_match_equal_text(t: Tables) -> DataFrame:
    return _rounded(D.find_matches(t.listings, t.stored, EXACT), "pos", "matched_seq")


@query("SELECT pos, title, company, description FROM listings WHERE pos NOT IN (SELECT pos FROM firsts)", **EQUAL)
def dedup_new_equal_text(t: Tables) -> DataFrame:
    return D.deduplicate(t.listings, t.stored, EXACT)[0].select("pos", "title", "company", "description")


DETAILS = """SELECT f.pos, s.company AS matched_company, s.title AS matched_title, s.description AS matched_description, s.url AS matched_url,
 '2026-01-01' AS matched_first_seen, round(f.company_score, 6) AS company_score, round(f.title_score, 6) AS title_score,
 round(f.description_score, 6) AS description_score FROM firsts f JOIN stored s ON s.seq = f.seq"""


@query(DETAILS, **EQUAL)
def dedup_matches_equal_text(t: Tables) -> DataFrame:
    return _details(t, EXACT)


# Matches of different texts, on listings short enough for the distance in SQL.


def _short(threshold: float) -> dict[str, str]:
    return {
        **SCORES,
        "nk": _keys("short_listings", "pos"),
        "sk": _keys("short_stored", "seq"),
        "met": """SELECT k.pos, s.seq, k.tx AS xa, s.tx AS xb, e.company_score, t.title_score FROM nk k JOIN title_scores t ON t.ta = k.nt
 JOIN sk s ON s.nt = t.tb JOIN company_scores e ON e.ca = k.nc AND e.cb = s.nc""",
        "compared": f"SELECT *, {S.ratio('xa', 'xb')} AS description_score FROM met",
        "short_firsts": f"""SELECT pos, seq, company_score, title_score, description_score FROM compared
 WHERE description_score >= {threshold} QUALIFY row_number() OVER (PARTITION BY pos ORDER BY seq) = 1""",
    }


SHORT_FIRST = """SELECT pos, seq AS matched_seq, round(company_score, 6) AS company_score, round(title_score, 6) AS title_score,
 round(description_score, 6) AS description_score FROM short_firsts"""
LOW = D.Thresholds(50, 80, 85)


@query(SHORT_FIRST, **_short(95))
def first_match_short(t: Tables) -> DataFrame:
    return _rounded(D.find_matches(t.short_listings, t.short_stored, THRESHOLDS), "pos", "matched_seq")


@query(SHORT_FIRST, **_short(85))
def first_match_short_85(t: Tables) -> DataFrame:
    return _rounded(D.find_matches(t.short_listings, t.short_stored, LOW), "pos", "matched_seq")


@query(
    "SELECT pos, title, company, description FROM short_listings WHERE pos NOT IN (SELECT pos FROM short_firsts)", **_short(95)
)
def dedup_new_short(t: Tables) -> DataFrame:
    return D.deduplicate(t.short_listings, t.short_stored, THRESHOLDS)[0].select("pos", "title", "company", "description")


@query(
    """SELECT f.pos, s.company AS matched_company, s.title AS matched_title, s.description AS matched_description, s.url AS matched_url,
 '2026-01-01' AS matched_first_seen, round(f.company_score, 6) AS company_score, round(f.title_score, 6) AS title_score,
 round(f.description_score, 6) AS description_score FROM short_firsts f JOIN short_stored s ON s.seq = f.seq""",
    **_short(85),
)
def dedup_matches_short_85(t: Tables) -> DataFrame:
    return _rounded(
        D.match_details(D.find_matches(t.short_listings, t.short_stored, LOW), t.short_stored),
        "pos", "matched_company", "matched_title", "matched_description", "matched_url", "matched_first_seen",
    )


@query(
    f"""SELECT nid, sid, round(description_score, 6) AS description_score FROM (SELECT *, {S.ratio('xa', 'xb')} AS description_score FROM
 (SELECT a.nid, b.sid, a.tx AS xa, b.tx AS xb FROM (SELECT tx, min(pos) AS nid FROM nk GROUP BY tx) a
 JOIN (SELECT tx, min(seq) AS sid FROM sk GROUP BY tx) b ON abs(length(a.tx) - length(b.tx)) <= 6 AND a.tx <> b.tx) q) r
 WHERE description_score >= 95""",
    **_short(95),
)
def verify_text_short(t: Tables) -> DataFrame:
    """Pairs of different short texts that reach the threshold."""
    new = D.distinct_texts(D.with_keys(t.short_listings), "pos", "nid")
    stored = D.distinct_texts(D.with_keys(t.short_stored), "seq", "sid")
    found = D.similar_texts(new, stored, 95)
    return found.select("nid", "sid", F.round("description_score", 6).alias("description_score"))


_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"


def _e(column: str) -> str:
    return _ESC.format(column)


def _score(label: str, column: str) -> str:
    return (
        f"concat('<li style=\"color:', CASE WHEN {column} >= 90 THEN '#e74c3c' WHEN {column} >= 80 THEN '#e67e22' "
        f"ELSE '#27ae60' END, '\">{label}: ', printf('%.0f', {column}), ' of 100</li>')"
    )


def _line(label: str, ours: str, theirs: str) -> str:
    return f"concat('<tr><th>{label}</th><td>', {ours}, '</td><td>', {theirs}, '</td></tr>')"


def _link(column: str) -> str:
    return f"CASE WHEN {column} <> '' THEN concat('<a href=\"', {_e(column)}, '\">[link]</a>') ELSE '' END"


def _whole(column: str) -> str:
    return f"concat('<pre>', {_e(column)}, '</pre>')"


@query(
    f"""SELECT n, pos, concat('<section id="duplicate-', n, '"><h2>', n, '. ', {_e('title')}, ', ', {_e('company')}, '</h2>',
 '<table><tr><td></td><th>this run</th><th>store</th></tr>',
 {_line('title', _e('title'), _e('matched_title'))}, {_line('company', _e('company'), _e('matched_company'))},
 {_line('link', _link('url'), _link('matched_url'))}, {_line('first seen', "''", _e('matched_first_seen'))},
 {_line('text', _whole('description'), _whole('matched_description'))}, '</table><ul>',
 {_score('company', 'company_score')}, {_score('title', 'title_score')}, {_score('text', 'description_score')}, '</ul></section>') AS fragment
 FROM (SELECT d.*, l.title, l.company, l.url, l.description, row_number() OVER (ORDER BY d.pos) AS n
 FROM details d JOIN listings l ON l.pos = d.pos) q""",
    **EQUAL,
    details=DETAILS,
)
def dup_report_equal_text(t: Tables) -> DataFrame:
    return _dup_report(t, EXACT)


@query()
def dup_report(t: Tables) -> DataFrame:
    return _dup_report(t, THRESHOLDS)


def _dup_report(t: Tables, thresholds: D.Thresholds) -> DataFrame:
    matches = D.match_details(D.find_matches(t.listings, t.stored, thresholds), t.stored)
    return report.dup_report(t.listings, matches).select("n", "pos", "fragment")
