"""From the stored pages of each board to listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from checks import sqltext as S
from checks.registry import query
from checks.tables import Tables
from siftline.plans.pages import page_listings
from siftline.schemas import SNAPSHOT

SHOWN = ["page", "title", "company", "location", "url", "date_posted", "description"]
# The detail page of a key is the last one stored.
DETAIL = "SELECT key, max(page_id) AS page_id FROM board_jobs WHERE NOT lost AND key <> '' GROUP BY key"
JOINED = """SELECT c.*, d.page_id AS detail_id, j.body AS found, j.textless AS no_text
 FROM cards c LEFT JOIN detail d ON d.key = c.key LEFT JOIN board_jobs j ON j.page_id = d.page_id"""
FIRST_OF_PAGE = "SELECT *, row_number() OVER (PARTITION BY page, key ORDER BY page_id) AS nth FROM board_jobs WHERE key <> ''"


def snapshots(t: Tables, source: str, card: str, detail: str, url: str, top: str = "", end: str = "", at: str = "0") -> DataFrame:
    """Stored pages of a board: ``card`` and ``detail`` are SQL for the HTML of a job, ``at`` for the place of its detail."""
    jobs = t.board_jobs.withColumn("card", F.expr(card))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_id", "card"))), lambda c: c["card"])
    stored = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id"))
    results = jobs.groupBy("page").agg(F.concat(F.lit(top), F.array_join(ordered, "\n"), F.lit(end)).alias("html"), F.max("page_id").alias("page_id"))
    details = jobs.withColumn("pos", F.expr(at).cast("bigint")).where("not lost")

    def rows(df: DataFrame, kind: str, pos: Column, address: Column, html: Column) -> DataFrame:
        columns = (F.lit(source), F.lit(kind), F.col("page"), pos, address, html, stored)
        return df.select(*[c.alias(f.split()[0]) for c, f in zip(columns, SNAPSHOT.split(", "))])

    no = lambda kind: F.lit(None).cast(kind)
    return rows(results, "results", no("bigint"), no("string"), F.col("html")).unionByName(
        rows(details, "detail", F.col("pos"), F.expr(url), F.expr(detail))
    )


@query(
    f"""SELECT page, title, company, location, concat('https://www.indeed.com/viewjob?jk=', key) AS url, '' AS date_posted,
 {S.strip_text('found')} AS description FROM joined WHERE NOT no_text""",
    detail=DETAIL, first="SELECT *, row_number() OVER (PARTITION BY page, key ORDER BY page_id) AS nth FROM board_jobs WHERE key <> '' AND NOT hidden",
    cards="SELECT * FROM first WHERE nth = 1", joined=JOINED,
)
def indeed_pages(t: Tables) -> DataFrame:
    stored = snapshots(
        t, "indeed",
        """concat('<div class="cardOutline tapItem result"', if(hidden, ' aria-hidden="true"', ''), '><h2 class="jobTitle"><a class="x jcs-JobTitle" ',
 if(key = '', '', concat('data-jk="', key, '"')), ' href="#"><span>', replace(title, '&', '&amp;'), '</span></a></h2><span data-testid="company-name">', company,
 '</span><div data-testid="text-location">', location, '</div></div>')""",
        "concat('<html><DIV id=\"nav\">no</DIV>', if(textless, '', concat('<div class=\"c\" id=\"jobDescriptionText\">', body, '</div>')), '<div>after</div></html>')",
        "concat('https://www.indeed.com/viewjob?jk=', key)", '<div id="mosaic-provider-jobcards">', "</div>",
    )
    return page_listings(stored, "indeed").select(*SHOWN)


@query(
    f"""SELECT page, title, CASE WHEN page_id % 3 <> 0 THEN company WHEN detail_id % 5 = 0 THEN concat('Hired ', detail_id)
  WHEN detail_id % 5 = 3 THEN concat('Other ', detail_id) ELSE '' END AS company, location,
 CASE WHEN detail_id % 5 = 0 THEN concat('https://apply.example.com/', detail_id) ELSE concat('https://hiring.cafe/job/', key) END AS url,
 CASE WHEN page_id % 2 = 0 THEN '3d ago' ELSE '' END AS date_posted, {S.strip_text('found')} AS description
FROM joined WHERE NOT no_text AND detail_id % 5 <> 1 AND page_id % 23 <> 7""",
    detail=DETAIL, first=FIRST_OF_PAGE, cards="SELECT * FROM first WHERE nth = 1", joined=JOINED,
)
def hiring_cafe_pages(t: Tables) -> DataFrame:
    job = "<script id=\"__NEXT_DATA__\" type=\"application/json\">{\"props\":{\"pageProps\":{\"job\":"
    stored = snapshots(
        t, "hiring_cafe",
        """concat('<div class="card"><div class="row"><svg><path/></svg>', if(page_id % 2 = 0, '<span>3d</span>', ''), '</div>',
 CASE WHEN page_id % 23 = 7 THEN '' WHEN page_id % 23 = 8 THEN concat('<div class="t"><span>', replace(title, '&', '&amp;'), '</span></div>')
  ELSE concat('<span class="text-start x font-bold">', replace(title, '&', '&amp;'), '</span>') END,
 '<a href="', if(key = '', '/about', concat('/job/', key)), '">go</a>', if(page_id % 3 = 0, '', concat('<picture><img src="x" alt="', company, '"></picture>')),
 '<div><svg></svg><span>', location, '</span></div></div>')""",
        f"""concat('<html>', CASE page_id % 5 WHEN 0 THEN concat('{job}{{"apply_url":"https://apply.example.com/', page_id, '","v5_processed_job_data":{{"company_name":" Hired ', page_id, ' "}}}}}}}}}}</script>')
  WHEN 1 THEN '{job}null}}}}}}</script>' WHEN 3 THEN concat('{job}{{"apply_url":"/rel","enriched_company_data":{{"name":"Other ', page_id, '"}}}}}}}}}}</script>') ELSE '' END,
 if(textless, '', concat('<article class="prose lg">', body, '</article>')), '</html>')""",
        "concat('https://hiring.cafe/job/', key)", '<nav class="grid-like"><div>no</div></nav><div class="x grid">', "</div><div>foot</div>",
    )
    return page_listings(stored, "hiring_cafe").select(*SHOWN)


@query(
    f"""SELECT page, title, company, location,
 CASE WHEN detail_id % 3 = 0 THEN concat('https://apply.example.com/', detail_id) ELSE concat('https://remotive.com/j/', key) END AS url,
 '2026-01-05' AS date_posted, CASE WHEN no_text THEN '' ELSE {S.strip_text('found')} END AS description
FROM joined WHERE detail_id IS NOT NULL""",
    detail=DETAIL, keys="SELECT key, min(page) AS page FROM board_jobs WHERE key <> '' GROUP BY key",
    cards="SELECT b.* FROM board_jobs b JOIN keys k ON k.key = b.key AND k.page = b.page", joined=JOINED,
)
def remotive_pages(t: Tables) -> DataFrame:
    stored = snapshots(
        t, "remotive",
        """concat('<button class="b job-apply-btn--list" ', if(key = '', '', concat('data-job-id="', key, '" ')), "data-job-title='", replace(title, '&', '&amp;'),
 "' data-company-name=\\"", company, '" data-location="', location, '" data-publication-date="2026-01-05" data-job-url="',
 if(page_id % 2 = 0, 'https://remotive.com', ''), '/j/', key, '">Apply</button>')""",
        """concat('<a class="remotive-btn-chocolate job-tile-apply" href="/no">Apply for this position</a>', if(page_id % 3 = 0,
 concat('<a href="https://apply.example.com/', page_id, '" class="remotive-btn-chocolate"><b>Apply for this</b> position</a>'), ''),
 if(textless, '', concat('<div class="left">', body, '</div>')))""",
        "concat('https://remotive.com/j/', key)",
    )
    return page_listings(stored, "remotive").select(*SHOWN)


@query(
    f"""SELECT page, title, company, location,
 CASE WHEN lost THEN '' WHEN page_id % 7 = 2 THEN 'https://www.linkedin.com/jobs/search' ELSE concat('https://www.linkedin.com/jobs/view/', page_id, '/') END AS url,
 CASE WHEN lost OR page_id % 3 = 0 THEN '' ELSE 'Reposted 2 weeks ago' END AS date_posted,
 CASE WHEN lost OR textless THEN '' ELSE {S.strip_text('body')} END AS description FROM board_jobs WHERE key <> ''""",
)
def linkedin_pages(t: Tables) -> DataFrame:
    stored = snapshots(
        t, "linkedin",
        """concat('<div role="button" componentkey="u', page_id, '">', if(key = '', '<p>foot</p>', concat('<button aria-label="Dismiss ', replace(title, '&', '&amp;'),
 ' job">x</button>')), '<p>', title, '</p><p class="c">', company, '</p><p><span>', location, '</span></p></div>')""",
        """concat('<strong>Today</strong>', if(page_id % 3 = 0, '', '<strong class="d">Reposted <b>2 weeks</b> ago</strong>'),
 '<div componentkey="JobDetails_AboutTheJob_1">', if(textless, '', concat('<span data-testid="expandable-text-box">', body, '</span>')), '</div>')""",
        "concat('https://www.linkedin.com/jobs/search', if(page_id % 7 = 2, '', concat('?currentJobId=', page_id, '&origin=x')))",
        '<div data-testid="lazy-column">', "</div>",
        at="if(key = '', null, sum(if(key = '', 0, 1)) over (partition by page order by page_id) - 1)",
    )
    # Details of cards that are none have no place.
    return page_listings(stored, "linkedin").select(*SHOWN)
