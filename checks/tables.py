"""Inputs of the registered queries, derived from the given tables.

Each derived table is one SQL text that Spark and DuckDB both run; only
``responses`` needs an ordered text aggregate and is written twice. All of them
cover their whole base tables.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline.operators.numbering import number_rows, pos_block

DERIVED = {
    # Every document as a listing.
    "listings": """
SELECT doc_id AS pos, CAST(floor(doc_id / 25) AS BIGINT) AS page,
 CASE doc_id % 4 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'indeed' WHEN 2 THEN 'hiring_cafe' ELSE 'remotive' END AS source,
 concat(upper(lang), CASE doc_id % 3 WHEN 0 THEN ' Data  Engineer.' WHEN 1 THEN ' Data Engineer II' ELSE ' Staff Data | Engineer' END) AS title,
 concat(d.source, CASE CAST(floor(doc_id / 20) AS BIGINT) % 5 WHEN 0 THEN ' Inc.' WHEN 1 THEN ', LLC' WHEN 2 THEN ' Payments' WHEN 3 THEN ' Technologies Inc.' ELSE '' END) AS company,
 concat('City ', doc_id % 25) AS location,
 concat('https://jobs.example.com/view?currentJobId=', doc_id, '&ref=x') AS url,
 CASE CAST(floor(doc_id / 4) AS BIGINT) % 8 WHEN 0 THEN '3 days ago' WHEN 1 THEN 'Reposted 2 weeks ago' WHEN 2 THEN '13 hours ago' WHEN 3 THEN '2mo ago'
  WHEN 4 THEN '3d ago' WHEN 5 THEN 'Just posted' WHEN 6 THEN '30+ days ago' ELSE '' END AS date_posted,
 text AS description
FROM {documents} d""",
    # The labelled documents, as seen by an earlier run.
    "stored": """
SELECT l.pos AS seq, l.company, l.title, l.url, l.description, DATE '2026-01-01' AS first_seen
FROM {listings} l JOIN {labels} b ON b.doc_id = l.pos""",
    # Customers and suppliers as listings with short texts, which SQL can compare at any threshold.
    "short_listings": """
SELECT c_custkey AS pos, concat(c_mktsegment, ' Desk Inc.') AS company, concat('Analyst ', c_mktsegment) AS title,
 concat('Reference ', lpad(CAST(c_custkey AS STRING), 9, '0'), ' for the ', c_mktsegment, ' desk of nation ', c_nationkey) AS description
FROM {customer}""",
    "short_stored": """
SELECT s_suppkey AS seq, concat(segment, ' Desk, LLC') AS company, concat('Senior Analyst ', segment) AS title,
 concat('https://jobs.example.com/view?currentJobId=', s_suppkey) AS url,
 concat('Reference ', lpad(CAST(s_suppkey AS STRING), 9, '0'), ' for the ', segment, ' desk of nation ', s_nationkey) AS description,
 DATE '2026-01-01' AS first_seen
FROM (SELECT *, CASE s_suppkey % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'HOUSEHOLD'
 ELSE 'MACHINERY' END AS segment FROM {supplier}) s""",
    # The labels with dense positions.
    "numbered": "SELECT doc_id, quality, toxic, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM {labels}",
    "blocks": """
SELECT i AS job_id, CAST(floor(i / 4) AS BIGINT) AS batch,
 CASE WHEN i % 29 = 7 THEN concat('JOB_ID: ', i, chr(10), 'STATUS: MAYBE')
      WHEN i % 31 = 9 THEN concat('JOB_ID: ', i, chr(10), 'STATUS: SCORED', chr(10), 'SCORE: 85/100', chr(10), 'REASONING: odd')
      WHEN toxic = 1 THEN concat('JOB_ID: ', i, chr(10), 'STATUS: FILTERED', chr(10), 'REASON: rule ', doc_id % 3, ' violated')
      ELSE concat('JOB_ID: ', i, chr(10), 'STATUS: SCORED', chr(10), 'SCORE: ', quality * 50 + doc_id % 50, chr(10),
        'REASONING: fits', chr(10), ' well enough', chr(10), chr(10), 'stray thought', chr(10), 'GAPS: none', chr(10),
        'HARD_REQUIREMENTS: - a | - b', chr(10), 'ADDRESS: ',
        CASE doc_id % 4 WHEN 0 THEN 'null' ELSE concat('Customer#', lpad(CAST(doc_id * 3 AS STRING), 9, '0')) END) END AS block
FROM {numbered} t""",
    # What the scorer should have answered for: one row per position.
    "expected": "SELECT CAST(floor(i / 4) AS BIGINT) AS batch, i AS pos FROM {numbered} t",
    # Results of an earlier scoring, with the listing they belong to.
    "results": """
SELECT l.pos, l.title, l.company, l.url, l.description,
 CASE WHEN l.pos % 29 = 7 THEN 'failed' WHEN toxic = 1 THEN 'filtered' ELSE 'scored' END AS result_type,
 CASE WHEN l.pos % 29 = 7 THEN 'scorer failed' WHEN toxic = 1 THEN concat('rule ', l.pos % 3, ' violated') END AS reason,
 CASE WHEN l.pos % 29 <> 7 AND toxic = 0 THEN CAST(quality * 50 + l.pos % 50 AS INT) END AS score,
 CASE WHEN l.pos % 29 <> 7 AND toxic = 0 THEN CAST(l.pos % 100 AS INT) END AS requirements_match,
 CASE WHEN l.pos % 29 <> 7 AND toxic = 0 THEN CAST(l.pos % 90 AS INT) END AS domain_match,
 CASE WHEN l.pos % 29 <> 7 AND toxic = 0 THEN 'fits well' END AS reasoning,
 CASE WHEN l.pos % 29 <> 7 AND toxic = 0 THEN 'none' END AS gaps,
 CASE WHEN l.pos % 29 <> 7 AND toxic = 0 THEN '- a | - b |' END AS hard_requirements,
 CASE WHEN l.pos % 29 <> 7 AND toxic = 0 THEN 'None listed' END AS preferred_requirements,
 CASE WHEN l.pos % 29 <> 7 AND toxic = 0 AND l.pos % 4 <> 0 THEN concat('Customer#', lpad(CAST(l.pos * 3 AS STRING), 9, '0')) END AS address
FROM {listings} l JOIN {labels} b ON b.doc_id = l.pos""",
    # Customers as known addresses, some of them known misses.
    "cache": """
SELECT c_name AS address,
 CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE CAST(47.60 AS DOUBLE) + (c_custkey % 100) * CAST(0.0021 AS DOUBLE) END AS lat,
 CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE CAST(-122.40 AS DOUBLE) + (c_custkey % 37) * CAST(0.0037 AS DOUBLE) END AS lon
FROM {customer}""",
    "locations": """
SELECT r_regionkey AS loc_pos, r_name AS name, CAST(47.62 AS DOUBLE) + r_regionkey * CAST(0.03 AS DOUBLE) AS lat,
 CAST(-122.39 AS DOUBLE) + r_regionkey * CAST(0.02 AS DOUBLE) AS lon,
 CASE WHEN r_regionkey % 2 = 0 THEN CAST(2.5 AS DOUBLE) END AS radius_km
FROM {region}""",
    # Pages with the embedded data that a board puts into them.
    "data_pages": """
SELECT page_id, url, concat(html, CASE page_id % 5
  WHEN 0 THEN concat('<script id="__NEXT_DATA__" type="application/json">{{"props":{{"pageProps":{{"job":{{"apply_url":"https://apply.example.com/', page_id, '","v5_processed_job_data":{{"company_name":" Firm ', page_id % 7, ' "}}}}}}}}}}</script>')
  WHEN 1 THEN '<script id="__NEXT_DATA__">{{"props":{{"pageProps":{{"job":null}}}}}}</script>'
  WHEN 2 THEN '<script id="__NEXT_DATA__">{{broken</script>'
  WHEN 3 THEN concat('<script id="__NEXT_DATA__">{{"props":{{"pageProps":{{"job":{{"apply_url":"/rel/', page_id, '","enriched_company_data":{{"name":"Other ', page_id % 3, '"}}}}}}}}}}</script>')
  ELSE '' END) AS html
FROM {pages}""",
    # What boards show of the pages: twenty cards a results page, keys that repeat on a page and across pages, and gaps.
    "board_jobs": """
SELECT page_id, CAST(floor(page_id / 20) AS BIGINT) AS page, concat('Role & ', page_id) AS title,
 concat('Firm ', page_id % 11) AS company, concat('City ', page_id % 25) AS location,
 CASE WHEN page_id % 13 = 5 THEN '' ELSE concat('k', CAST(floor(page_id % 97 / 2) AS BIGINT)) END AS key,
 page_id % 17 = 3 AS hidden, page_id % 19 = 4 AS lost, page_id % 11 = 6 AS textless,
 regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) AS body
FROM {pages}""",
    # Cards as found on board pages: keys repeat within and across pages, some fields are missing.
    "cards": """
SELECT pos, page, source, title, company, location, url, date_posted,
 CASE WHEN pos % 13 = 5 THEN '' ELSE concat('k', pos % 97) END AS key,
 pos % 17 = 3 AS hidden, pos % 19 = 4 AS failed,
 CASE WHEN pos % 11 = 6 THEN NULL ELSE description END AS description
FROM {listings}""",
}
RESPONSES_DUCKDB = """
SELECT batch, concat('Let me think.', chr(10), string_agg(block, concat(chr(10), chr(10)) ORDER BY job_id)) AS response
FROM blocks GROUP BY batch"""
GIVEN = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


class Tables:
    """The given and derived tables of one scale directory as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in GIVEN:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name in DERIVED:
            sql = DERIVED[name]
            needs = set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql))
            df = self.spark.sql(sql, **{n: getattr(self, n) for n in needs})
        else:
            raise AttributeError(name)
        setattr(self, name, df)
        return df

    @cached_property
    def numbered(self) -> DataFrame:
        rows = number_rows(self.labels, [("_block", pos_block(F.col("doc_id")))], [F.col("doc_id")], "n")
        return rows.select("doc_id", "quality", "toxic", (F.col("n") - 1).alias("i"))

    @cached_property
    def responses(self) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("job_id", "block")))
        text = F.array_join(F.transform(ordered, lambda b: b["block"]), "\n\n")
        return self.blocks.groupBy("batch").agg(F.concat(F.lit("Let me think.\n"), text).alias("response"))


def oracle(sql: str, given: dict[str, str] | None = None) -> str:
    """DuckDB text: ``sql`` with the derived tables that it names as CTEs."""
    bodies = {name: body.format(**{n: n for n in [*GIVEN, *DERIVED]}) for name, body in DERIVED.items()}
    bodies["responses"] = RESPONSES_DUCKDB
    bodies.update(given or {})
    needed: list[str] = []

    def need(text: str) -> None:
        for name in bodies:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                need(bodies[name])
                if name not in needed:
                    needed.append(name)

    need(sql)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{name} AS ({bodies[name].strip()})" for name in needed)
    rest = sql.strip()
    if rest.upper().startswith("WITH "):
        return f"WITH {ctes},\n{rest[5:]}"
    return f"WITH {ctes}\n{rest}"
