"""Answer parsing against a line-by-line reading, and whole batches."""

import json
import os
import random

from pyspark.sql import functions as F

from siftline.functions import protocol as P
from siftline.operators import scoring as B

RESPONSES = "batch bigint, response string, error string"


def read_block(block):
    """Values of a block, read line by line."""
    values, open_key = {}, None
    for line in block.splitlines():
        name, colon, rest = line.partition(": ")
        if colon and name.strip() in P.ANSWER_KEYS:
            open_key = name.strip()
            values[open_key] = [rest.strip()]
        elif not line.strip():
            open_key = None
        elif open_key:
            values[open_key].append(line.strip())
    return {k: " ".join(v) for k, v in values.items()}


def test_fields_of_random_blocks(spark):
    rng = random.Random(3)
    pool = ["JOB_ID: 3", "STATUS: SCORED", " SCORE : 5", "REASON: a: b", "REASONING:  x ", "REASONING", "more text", "  ", "", "",
            "GAPS:none", "GAPS: g split", "note: SCORE: 4", "ADDRESS: n/a", "tail\x0cREQS_MATCH: 1", "a\r\nb"]
    blocks = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12))).strip() for _ in range(400)]
    blocks = [b for b in blocks if b]
    df = spark.createDataFrame([(0, i, b) for i, b in enumerate(blocks)], "batch bigint, block_pos int, block string")
    for r in B.parse_fields(df).collect():
        got = {k: r[k] for k in P.ANSWER_KEYS if r[k] is not None}
        assert got == read_block(blocks[r.block_pos]), blocks[r.block_pos]


def results_of(spark, *responses, size=2):
    rows = [(i, r, None) if not isinstance(r, Exception) else (i, None, str(r)) for i, r in enumerate(responses)]
    expected = spark.range(size * len(rows)).select(F.floor(F.col("id") / size).alias("batch"), F.col("id").alias("pos"))
    found = B.parse_responses(spark.createDataFrame(rows, RESPONSES), expected).collect()
    return {r.pos: r for r in found}


SCORED = "JOB_ID: {}\nSTATUS: SCORED\nSCORE: {}\nREASONING: ok"


def test_batches(spark):
    both = lambda a, b: a + "\n\n" + b
    r = results_of(
        spark,
        "thinking\nJOB_ID is next\n```text\n" + both(SCORED.format(0, "+7"), SCORED.format(1, " 1_0 ")) + "\n```",
        both(SCORED.format(2, "85/100"), SCORED.format(3, 4)),
        both(SCORED.format(4, 1), SCORED.format(4, 2)) + "\n\n" + both(SCORED.format(5, 3), SCORED.format(99, 3)),
        SCORED.format(6, 1),
        RuntimeError("no connection"),
        "nothing here",
        both("JOB_ID:12\nSTATUS: SCORED", SCORED.format(13, 1)),
        both("JOB_ID: 14\nSTATUS: MAYBE", SCORED.format(15, 1)),
        both("JOB_ID: 16\nSTATUS: FILTERED", SCORED.format(17, 1)),
        "",
    )
    assert (r[0].score, r[1].score, r[0].gaps, r[0].hard_requirements) == (7, 10, P.DEFAULT_GAPS, "None listed")
    assert r[2].result_type == r[3].result_type == "failed"
    assert r[3].reason == "invalid literal for int() with base 10: '85/100'"
    assert (r[4].score, r[5].score) == (2, 3) and 99 not in r
    assert r[6].reason == r[7].reason == "Missing results for job IDs: [7]"
    assert r[8].reason == "no connection"
    assert r[10].reason == "Missing required field 'JOB_ID' in block:\nnothing here"
    assert r[12].reason == "Missing required field 'JOB_ID' in block:\nJOB_ID:12\nSTATUS: SCORED"
    assert r[14].reason == "Unknown STATUS 'MAYBE' in block:\nJOB_ID: 14\nSTATUS: MAYBE"
    assert r[16].reason == "Missing required field 'REASON' in FILTERED block:\nJOB_ID: 16\nSTATUS: FILTERED"
    assert r[18].reason == "Missing results for job IDs: [18, 19]"


def test_missing_batch(spark):
    listings = spark.createDataFrame([(0, "a"), (1, "b")], "pos bigint, title string")
    results = B.parse_responses(
        spark.createDataFrame([(0, SCORED.format(0, 5), None)], RESPONSES),
        spark.createDataFrame([(0, 0), (1, 1)], "batch bigint, pos bigint"),
    )
    got = {r.pos: (r.result_type, r.reason) for r in B.reassemble(listings, results).collect()}
    assert got == {0: ("scored", None), 1: ("failed", "Result missing from worker")}


def test_address_line_only_on_request():
    assert "ADDRESS: " in P.prompt_tail(P.Profile(request_address=True))
    assert "ADDRESS" not in P.prompt_tail(P.Profile())


def test_scorer_order_in_conversations(spark, tmp_path):
    rows = spark.range(40).select(
        F.col("id").alias("pos"), *[F.lit("x").alias(k) for k in ("title", "company", "location", "date_posted", "url", "description")]
    )
    prompts = B.continuation_prompts(B.assign_batches(rows, 4), P.Profile(), 3)
    later = {r.batch: r.prompt.startswith(P.CONTINUATION) for r in prompts.collect()}
    assert sorted(b for b, short in later.items() if not short) == [0, 1, 2]
    answered = B.score_batches(prompts, lambda prompt: str(len(prompt)))
    assert answered.count() == 10 and answered.where("error is not null").count() == 0
    # A scorer that notes what it sees: each conversation's batches come in order, in one task.
    log = tmp_path / "seen"
    log.mkdir()
    of = {r.prompt: (r.conversation, r.batch) for r in prompts.withColumn("prompt", F.concat("prompt", "batch")).collect()}

    def note(prompt):
        with open(log / str(os.getpid()), "a") as f:
            f.write(json.dumps(prompt) + "\n")
        return ""

    B.score_batches(prompts.withColumn("prompt", F.concat("prompt", "batch")), note, tasks=4).collect()
    seen = [[of[json.loads(line)] for line in open(f)] for f in log.iterdir()]
    assert sorted(sum(seen, [])) == sorted(of.values())
    for conversation in range(3):
        where = [[b for c, b in task if c == conversation] for task in seen]
        (own,) = [b for b in where if b]
        assert own == sorted(own) and own[0] == conversation
