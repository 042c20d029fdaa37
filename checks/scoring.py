"""Queries over the scoring protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from checks.registry import query
from checks.tables import Tables
from siftline.functions import protocol as P
from siftline.operators import scoring as B

c = F.col
PROFILE = P.Profile("Ten years of data work.", "No night shifts.", "Prefer small teams.", True)


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


HEAD, TAIL = _sql_text(P.prompt_head(PROFILE)), _sql_text(P.prompt_tail(PROFILE))
JOB_TEXT = (
    "concat('### JOB ', pos, chr(10), '- **Title:** ', title, chr(10), '- **Company:** ', company, chr(10), '- **Location:** ', location, "
    "chr(10), '- **Date posted:** ', date_posted, chr(10), '- **URL:** ', url, chr(10), '- **Description:**', chr(10), description)"
)
JOINED = {
    "joined": f"SELECT CAST(floor(pos / 4) AS BIGINT) AS batch, min(pos) AS start_index, count(*) AS n_jobs, "
    f"string_agg({JOB_TEXT}, concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY pos) AS jobs FROM listings GROUP BY 1"
}

# The same answers without the text protocol: what every block says.
TYPED = {
    "typed": """SELECT batch, i AS job_id,
 CASE WHEN i % 29 = 7 THEN 'maybe' WHEN i % 31 = 9 THEN 'odd' WHEN toxic = 1 THEN 'filtered' ELSE 'scored' END AS kind,
 CASE WHEN i % 29 = 7 THEN concat('Unknown STATUS ''MAYBE'' in block:', chr(10), 'JOB_ID: ', i, chr(10), 'STATUS: MAYBE')
  WHEN i % 31 = 9 THEN 'invalid literal for int() with base 10: ''85/100''' END AS error,
 doc_id, quality FROM (SELECT *, CAST(floor(i / 4) AS BIGINT) AS batch FROM numbered) q""",
    "answers": """SELECT batch, job_id, error, CASE kind WHEN 'odd' THEN 'scored' WHEN 'maybe' THEN NULL ELSE kind END AS result_type,
 CASE WHEN kind = 'filtered' THEN concat('rule ', doc_id % 3, ' violated') END AS reason,
 CASE WHEN kind = 'scored' THEN CAST(quality * 50 + doc_id % 50 AS INT) END AS score,
 CASE WHEN kind IN ('scored', 'odd') THEN 0 END AS requirements_match, CASE WHEN kind IN ('scored', 'odd') THEN 0 END AS domain_match,
 CASE kind WHEN 'scored' THEN 'fits well enough' WHEN 'odd' THEN 'odd' END AS reasoning,
 CASE kind WHEN 'scored' THEN 'none' WHEN 'odd' THEN 'No significant gaps identified' END AS gaps,
 CASE kind WHEN 'scored' THEN '- a | - b' WHEN 'odd' THEN 'None listed' END AS hard_requirements,
 CASE WHEN kind IN ('scored', 'odd') THEN 'None listed' END AS preferred_requirements,
 CASE WHEN kind = 'scored' AND doc_id % 4 <> 0 THEN concat('Customer#', lpad(CAST(doc_id * 3 AS STRING), 9, '0')) END AS address FROM typed""",
    "statuses": "SELECT batch, arg_min(error, job_id) FILTER (error IS NOT NULL) AS error FROM answers GROUP BY batch",
}
FIELDS = "result_type, reason, score, requirements_match, domain_match, reasoning, gaps, hard_requirements, preferred_requirements, address"


def typed(t: Tables) -> DataFrame:
    return B.type_results(B.parse_fields(B.split_blocks(t.responses)))


def expected(t: Tables) -> DataFrame:
    return t.numbered.select(F.floor(c("i") / 4).alias("batch"), c("i").alias("pos"))


@query("SELECT pos, CAST(floor(pos / 4) AS BIGINT) AS batch, CAST(floor(pos / 4) AS BIGINT) * 4 AS start_index FROM listings")
def assign_batches(t: Tables) -> DataFrame:
    return B.assign_batches(t.listings, 4).select("pos", "batch", "start_index")


@query("SELECT pos, CAST(floor(pos / 4) AS BIGINT) % 3 AS conversation FROM listings")
def assign_conversations(t: Tables) -> DataFrame:
    return B.assign_conversations(B.assign_batches(t.listings, 4), 3).select("pos", "conversation")


@query(f"SELECT pos, {JOB_TEXT} AS block FROM listings")
def format_job(t: Tables) -> DataFrame:
    return B.format_job(t.listings).select("pos", "block")


@query(f"SELECT batch, start_index, n_jobs, concat({HEAD}, jobs, {TAIL}) AS prompt FROM joined", **JOINED)
def build_prompts(t: Tables) -> DataFrame:
    return B.build_prompts(B.assign_batches(t.listings, 4), PROFILE)


@query(
    f"""SELECT batch, batch % 3 AS conversation, start_index, n_jobs, CASE WHEN row_number() OVER (PARTITION BY batch % 3 ORDER BY batch) = 1
 THEN concat({HEAD}, jobs, {TAIL}) ELSE concat({_sql_text(P.CONTINUATION)}, jobs) END AS prompt FROM joined""",
    **JOINED,
)
def continuation_prompts(t: Tables) -> DataFrame:
    return B.continuation_prompts(B.assign_batches(t.listings, 4), PROFILE, 3)


@query("SELECT batch, job_id % 4 AS block_pos, block FROM blocks")
def split_blocks(t: Tables) -> DataFrame:
    return B.split_blocks(t.responses).withColumn("block_pos", c("block_pos").cast("bigint"))


@query(
    """SELECT batch, job_id % 4 AS block_pos, 'JOB_ID' AS field, CAST(job_id AS STRING) AS value FROM typed
 UNION ALL SELECT batch, job_id % 4, 'STATUS', CASE kind WHEN 'maybe' THEN 'MAYBE' WHEN 'filtered' THEN 'FILTERED' ELSE 'SCORED' END FROM typed
 UNION ALL SELECT batch, job_id % 4, 'SCORE', CASE kind WHEN 'odd' THEN '85/100' ELSE CAST(quality * 50 + doc_id % 50 AS STRING) END FROM typed WHERE kind IN ('scored', 'odd')
 UNION ALL SELECT batch, job_id % 4, 'REASONING', CASE kind WHEN 'odd' THEN 'odd' ELSE 'fits well enough' END FROM typed WHERE kind IN ('scored', 'odd')
 UNION ALL SELECT batch, job_id % 4, 'REASON', concat('rule ', doc_id % 3, ' violated') FROM typed WHERE kind = 'filtered'
 UNION ALL SELECT batch, job_id % 4, 'GAPS', 'none' FROM typed WHERE kind = 'scored'
 UNION ALL SELECT batch, job_id % 4, 'HARD_REQUIREMENTS', '- a | - b' FROM typed WHERE kind = 'scored'
 UNION ALL SELECT batch, job_id % 4, 'ADDRESS', CASE doc_id % 4 WHEN 0 THEN 'null' ELSE concat('Customer#', lpad(CAST(doc_id * 3 AS STRING), 9, '0')) END FROM typed WHERE kind = 'scored'""",
    **TYPED,
)
def parse_fields(t: Tables) -> DataFrame:
    fields = B.parse_fields(B.split_blocks(t.responses))
    long = fields.unpivot(["batch", "block_pos"], P.ANSWER_KEYS, "field", "value").where(c("value").isNotNull())
    return long.withColumn("block_pos", c("block_pos").cast("bigint"))


@query(f"SELECT batch, job_id, error, {FIELDS} FROM answers", **TYPED)
def type_results(t: Tables) -> DataFrame:
    return typed(t).drop("block_pos")


@query("SELECT batch, error FROM statuses", **TYPED)
def batch_status(t: Tables) -> DataFrame:
    return B.batch_status(typed(t), expected(t), t.responses)


@query(f"SELECT batch, job_id, {FIELDS} FROM answers", **TYPED)
def last_block(t: Tables) -> DataFrame:
    """The answers, each given twice: a first draft under the same number comes before it."""
    answers = typed(t)
    draft = answers.withColumn("block_pos", c("block_pos") - 100).withColumn("reasoning", F.lit("draft"))
    return B.last_block(draft.unionByName(answers))


@query("SELECT CAST(floor(pos / 4) AS BIGINT) AS batch, pos FROM listings WHERE pos NOT IN (SELECT i FROM numbered)")
def missing_ids(t: Tables) -> DataFrame:
    """Listings asked about that the answers leave out."""
    asked = B.assign_batches(t.listings, 4).select("batch", "pos")
    return B.missing_ids(asked, typed(t))


@query(
    f"""SELECT job_id AS pos, CASE WHEN s.error IS NULL THEN a.result_type ELSE 'failed' END AS result_type,
 CASE WHEN s.error IS NULL THEN a.reason ELSE s.error END AS reason,
 {', '.join(f'CASE WHEN s.error IS NULL THEN a.{f} END AS {f}' for f in FIELDS.split(', ')[2:])}
 FROM answers a JOIN statuses s ON s.batch = a.batch""",
    **TYPED,
)
def isolate_failures(t: Tables) -> DataFrame:
    return B.parse_responses(t.responses, expected(t))


@query(
    """SELECT l.pos, l.title, CASE WHEN a.job_id IS NULL OR s.error IS NOT NULL THEN 'failed' ELSE a.result_type END AS result_type,
 CASE WHEN a.job_id IS NULL THEN 'Result missing from worker' WHEN s.error IS NULL THEN a.reason ELSE s.error END AS reason,
 CASE WHEN s.error IS NULL THEN a.score END AS score
 FROM listings l LEFT JOIN answers a ON a.job_id = l.pos LEFT JOIN statuses s ON s.batch = a.batch""",
    **TYPED,
)
def reassemble(t: Tables) -> DataFrame:
    results = B.parse_responses(t.responses, expected(t))
    return B.reassemble(t.listings, results).select("pos", "title", "result_type", "reason", "score")


@query(
    """SELECT l.pos, l.title, CASE WHEN s.error IS NULL THEN a.result_type ELSE 'failed' END AS result_type
 FROM listings l JOIN answers a ON a.job_id = l.pos JOIN statuses s ON s.batch = a.batch""",
    **TYPED,
)
def join_results(t: Tables) -> DataFrame:
    return B.join_results(t.listings, B.parse_responses(t.responses, expected(t))).select("pos", "title", "result_type")


def keyword_scorer(prompt: str) -> str:
    """Offline scorer for the checks: answers from the listing texts of the prompt itself."""
    blocks = []
    for part in prompt.split("### JOB ")[1:]:
        job_id = part.split("\n", 1)[0]
        title = part.split("- **Title:** ", 1)[1].split("\n", 1)[0]
        if "Staff" in title:
            blocks.append(f"JOB_ID: {job_id}\nSTATUS: FILTERED\nREASON: too senior")
        else:
            blocks.append(
                f"JOB_ID: {job_id}\nSTATUS: SCORED\nSCORE: {int(job_id) % 100}\nREASONING: {title.strip()}"
            )
    if "City 7\n" in prompt:
        raise RuntimeError("no answer")
    return "\n\n".join(blocks)


@query(
    """SELECT pos, CASE WHEN bad THEN 'failed' WHEN contains(title, 'Staff') THEN 'filtered' ELSE 'scored' END AS result_type,
 CASE WHEN bad THEN 'no answer' WHEN contains(title, 'Staff') THEN 'too senior' END AS reason,
 CASE WHEN NOT bad AND NOT contains(title, 'Staff') THEN CAST(pos % 100 AS INT) END AS score,
 CASE WHEN NOT bad AND NOT contains(title, 'Staff') THEN title END AS reasoning
 FROM (SELECT *, bool_or(location = 'City 7') OVER (PARTITION BY floor(pos / 4)) AS bad FROM listings) q"""
)
def score_batches(t: Tables) -> DataFrame:
    """All listings through prompts, a user function and the answer parser."""
    from siftline.session import materialize

    asked = B.assign_batches(t.listings, 4)
    prompts = B.continuation_prompts(asked, PROFILE, 3)
    answers = materialize(B.score_batches(prompts, keyword_scorer, turn_mb=B.TURN_MB), "answers")
    results = B.parse_responses(answers, asked.select("batch", "pos"))
    return results.select("pos", "result_type", "reason", "score", "reasoning")
