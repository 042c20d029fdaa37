"""The scoring job: batches, prompts, the user's scorer, and its text answers.

A batch is one row on the way out (a prompt) and one row on the way back (an
answer). Everything but the user's function is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline.functions import protocol as P
from siftline.functions.text import WS, parse_address, strip
from siftline.session import scratch_path, small_batches

# Prompts that a task holds as Python texts at a time.
ASKED = 64
# Where conversations go in turns: megabytes of prompts that a task is asked in a turn, and how many consecutive batch numbers a turn never parts.
TURN_MB = 64
TURN_BLOCK = 256
# All line ends that a text can have, CR LF counting as one.
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x85\u2028\u2029]"
# Fixed value: an integer as the scorer may write it.
INTEGER = r"\A[+-]?[0-9]+(?:_[0-9]+)*\z"

PAYLOAD = [
    "result_type", "reason", "score", "requirements_match", "domain_match", "reasoning",
    "gaps", "hard_requirements", "preferred_requirements", "address",
]


def assign_batches(df: DataFrame, size: int, pos: str = "pos") -> DataFrame:
    """Consecutive runs of ``size`` rows of a dense ``pos``."""
    batch = F.floor(F.col(pos) / size).cast("bigint")
    return df.withColumn("batch", batch).withColumn("start_index", F.col("batch") * size)


def assign_conversations(df: DataFrame, concurrency: int) -> DataFrame:
    return df.withColumn("conversation", F.pmod(F.col("batch"), F.lit(concurrency)).cast("bigint"))


def format_job(df: DataFrame, pos: str = "pos") -> DataFrame:
    """Add ``block``, the text of one listing in a prompt."""
    # Labels of the listing text.
    return df.withColumn(
        "block",
        F.concat(
            F.lit("### JOB "), F.col(pos).cast("string"),
            F.lit("\n- **Title:** "), F.col("title"),
            F.lit("\n- **Company:** "), F.col("company"),
            F.lit("\n- **Location:** "), F.col("location"),
            F.lit("\n- **Date posted:** "), F.col("date_posted"),
            F.lit("\n- **URL:** "), F.col("url"),
            F.lit("\n- **Description:**\n"), F.col("description"),
        ),
    )


def join_blocks(df: DataFrame, pos: str = "pos") -> DataFrame:
    """One row per batch with the listing texts in order; a batch has ``size`` rows at most."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), "block")))
    return (
        format_job(df, pos)
        .groupBy("batch")
        .agg(ordered.alias("_blocks"), F.min(pos).alias("start_index"), F.count("*").alias("n_jobs"))
        .withColumn("jobs", F.array_join(F.transform("_blocks", lambda b: b["block"]), P.BLOCK_SEPARATOR))
        .drop("_blocks")
    )


def _opening_prompt(profile: P.Profile) -> Column:
    return F.concat(F.lit(P.prompt_head(profile)), F.col("jobs"), F.lit(P.prompt_tail(profile)))


def build_prompts(df: DataFrame, profile: P.Profile, pos: str = "pos") -> DataFrame:
    """One full prompt per batch."""
    joined = join_blocks(df, pos).withColumn("prompt", _opening_prompt(profile))
    return joined.select("batch", "start_index", "n_jobs", "prompt")


def continuation_prompts(
    df: DataFrame, profile: P.Profile, concurrency: int, pos: str = "pos"
) -> DataFrame:
    """Full prompt for the first batch of a conversation, a short one for later batches.

    Batch k belongs to conversation k mod ``concurrency``, so the first batch
    of a conversation is the one with k below ``concurrency``.
    """
    joined = assign_conversations(join_blocks(df, pos), concurrency)
    prompt = F.when(F.col("batch") < concurrency, _opening_prompt(profile)).otherwise(
        F.concat(F.lit(P.CONTINUATION), F.col("jobs"))
    )
    return joined.withColumn("prompt", prompt).select(
        "batch", "conversation", "start_index", "n_jobs", "prompt"
    )


def score_batches(
    prompts: DataFrame, scorer: Callable[[str], str], tasks: int | None = None, keep: tuple[str, ...] = ("batch",),
    turn_mb: int | None = None,
) -> DataFrame:
    """Answers of ``scorer(prompt)``, one row per batch, with the columns ``keep`` of the prompt.

    An exception fails its own batch: it becomes the ``error`` of the row.
    With a ``conversation`` column, the batches of one conversation run in
    order in one task. The prompts are dealt to ``tasks`` tasks, by default as many as
    ``spark.sql.shuffle.partitions``: an explicit number, since small prompts would be merged
    into few tasks while their answers take seconds each. A prompt holds the whole texts of its listings, so
    a task takes small batches of them, and few at a time as Python texts.

    With ``turn_mb``, conversations of more megabytes go in turns, see ``_score_in_turns``: for a scorer
    whose state, if it has any, is its own (attributes, a closure) and can be pickled. Without, a
    conversation is one task however long it is, and a scorer may hold on to anything, such as a connection.
    """
    small_batches(prompts)
    n_tasks = int(tasks or prompts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if turn_mb and "conversation" in prompts.columns:
        return _score_in_turns(prompts, scorer, n_tasks, keep, turn_mb)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ASKED):
                part = batch.slice(at, ASKED)
                responses, errors = [], []
                for prompt in part.column("prompt").to_pylist():
                    response, error = _ask(scorer, prompt)
                    responses.append(response)
                    errors.append(error)
                columns = [part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(responses, pa.string()), pa.array(errors, pa.string())], [*keep, "response", "error"]
                )

    if "conversation" in prompts.columns:
        prompts = prompts.repartition(n_tasks, "conversation").sortWithinPartitions("conversation", "batch")
    else:
        prompts = prompts.repartition(n_tasks, "batch")
    kept = "".join(f"{c} {prompts.schema[c].dataType.simpleString()}, " for c in keep)
    return prompts.select(*keep, "prompt").mapInArrow(answer, f"{kept}response STRING, error STRING")


def _ask(scorer: Callable[[str], str], prompt: str) -> tuple[str | None, str | None]:
    try:
        return scorer(prompt), None
    except Exception as e:
        return None, str(e)


def _score_in_turns(
    prompts: DataFrame, scorer: Callable[[str], str], n_tasks: int, keep: tuple[str, ...], turn_mb: int
) -> DataFrame:
    """Conversations in turns, one job after the other, so that no task reads more than ``turn_mb`` and one block of batches.

    Every conversation begins with its own copy of the scorer. At the end of a turn the scorer, with what it
    has learnt, is pickled into a row, and that row comes before the prompts of the conversation's next turn: it
    sees the same prompts in the same order as in one task. The prompts are written
    once, in order of their batches and in small pages, so that a turn reads its own. If all fits one turn, nothing is handed on.
    """
    spark = prompts.sparkSession
    path = scratch_path(spark, "turns")
    needed = [c for c in prompts.columns if c in {*keep, "conversation", "batch", "prompt"}]
    sized = prompts.select(*needed, F.coalesce(F.octet_length("prompt"), F.lit(0)).alias("_size"))
    sized.sortWithinPartitions("batch").write.option("parquet.page.row.count.limit", ASKED).parquet(f"{path}/prompts")
    told = spark.read.schema(sized.schema).parquet(f"{path}/prompts")
    turns = _turns(told, n_tasks, turn_mb)
    told = told.drop("_size")
    if len(turns) == 1:
        return score_batches(told, scorer, n_tasks, keep)

    first = cloudpickle.dumps(scorer)

    def turn_of(hand_on: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            talk, own = None, None

            def handed() -> list[dict]:
                if not hand_on or not talk:
                    return []
                try:
                    return [{"_talk": talk[0], "_scorer": cloudpickle.dumps(own)}]
                except Exception as e:
                    raise TypeError("a scorer that is asked in turns (turn_mb) must be picklable after use") from e

            for batch in batches:
                types = {f.name: f.type for f in batch.schema}
                schema = pa.schema(
                    [*[(c, types[c]) for c in keep], ("response", pa.string()), ("error", pa.string()),
                     ("_talk", types["conversation"]), ("_scorer", pa.binary())]
                )
                for at in range(0, batch.num_rows, ASKED):
                    rows = []
                    for row in batch.slice(at, ASKED).to_pylist():
                        if talk != (row["conversation"],):
                            rows += handed()
                            talk, own = (row["conversation"],), cloudpickle.loads(row["_scorer"] or first)
                        if row["_scorer"] is None:
                            response, error = _ask(own, row["prompt"])
                            rows.append({c: row[c] for c in keep} | {"response": response, "error": error})
                    yield pa.RecordBatch.from_pylist(rows, schema)
            if talk:
                yield pa.RecordBatch.from_pylist(handed(), schema)

        return go_on

    type_of = lambda c: told.schema[c].dataType.simpleString()
    answered = "".join(f"{c} {type_of(c)}, " for c in keep) + f"response STRING, error STRING, _talk {type_of('conversation')}, _scorer BINARY"
    read = lambda *turns: spark.read.schema(answered).parquet(*[f"{path}/turn-{i}" for i in turns])
    for i, turn in enumerate(turns):
        asked = told.where(turn).withColumn("_scorer", F.lit(None).cast("binary"))
        if i:
            scorers = read(i - 1).where("_scorer is not null").select(F.col("_talk").alias("conversation"), "_scorer")
            asked = asked.unionByName(scorers, allowMissingColumns=True)
        dealt = asked.repartition(n_tasks, "conversation").sortWithinPartitions("conversation", F.col("_scorer").isNull(), "batch")
        dealt.mapInArrow(turn_of(i + 1 < len(turns)), answered).write.parquet(f"{path}/turn-{i}")
    return read(*range(len(turns))).where("_scorer is null").select(*keep, "response", "error")


def _turns(told: DataFrame, n_tasks: int, turn_mb: int) -> list[Column]:
    """Conditions on ``batch``, one per turn, that part ``told`` (conversation, batch, _size) into ranges in order.

    Added up are blocks of batches, one narrow row each, by what the fullest of the tasks gets of a block.
    """
    block, task = F.floor(F.col("batch") / TURN_BLOCK), F.pmod(F.hash("conversation"), F.lit(n_tasks))
    dealt = told.groupBy(block.alias("block"), task.alias("task")).agg(F.sum("_size").alias("size"))
    before = F.sum("size").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    turn = F.floor(F.coalesce(before, F.lit(0)) / (turn_mb << 20))
    blocks = dealt.groupBy("block").agg(F.max("size").alias("size")).select("block", turn.alias("turn"))
    starts = blocks.groupBy("turn").agg(F.min("block").alias("start")).orderBy("turn").collect()
    cuts = [r.start * TURN_BLOCK for r in starts[1:]]
    if not cuts:
        return [F.lit(True)]
    batch = F.col("batch")
    return [
        batch.isNull() | (batch < cuts[0]),
        *[(batch >= low) & (batch < high) for low, high in zip(cuts, cuts[1:])],
        batch >= cuts[-1],
    ]


def split_blocks(responses: DataFrame) -> DataFrame:
    """One row per answer block: text from a line-start ``JOB_ID:`` to the next."""
    text, at = F.col("response"), F.locate("\nJOB_ID:", F.col("response"))
    from_first = F.when(F.startswith(text, F.lit("JOB_ID:")) | (at == 0), text).otherwise(
        F.substring(text, at + 1, F.length(text))
    )
    unfenced = strip(F.regexp_replace(from_first, r"(?U)```\w*", ""))
    blocks = F.transform(F.split(unfenced, r"(?md)(?=^JOB_ID:)"), strip)
    return responses.select(
        "batch", F.posexplode(F.filter(blocks, lambda b: b != "")).alias("block_pos", "block")
    )


def parse_fields(blocks: DataFrame) -> DataFrame:
    """Add one column per answer key, null where a block lacks the key.

    A line with a known key before its first ": " starts a value. The value
    goes on over the following lines up to a blank line or the next key line.
    A repeated key counts with its last value.
    """
    key_of = rf"(?s)\A{WS}*({'|'.join(P.ANSWER_KEYS)}){WS}*: .*"

    def read(lines: Column, marked: Column) -> Column:
        positions = F.sequence(F.lit(0), F.size(lines) - 1)
        ends_value = lambda i: (F.get(marked["keys"], i) != "") | (F.get(marked["texts"], i) == "")

        def from_line(at: Column, ends: Column) -> Column:
            end = F.coalesce(F.array_min(F.filter(ends, lambda i: i > at)), F.size(lines))
            first = strip(F.regexp_extract(F.get(lines, at), r"(?s)\A.*?: (.*)\z", 1))
            rest = F.slice(marked["texts"], at + 2, end - at - 1)
            return F.when(at.isNotNull(), F.array_join(F.concat(F.array(first), rest), " "))

        def value(key: Column, ends: Column) -> Column:
            last = F.array_max(F.filter(positions, lambda i: F.get(marked["keys"], i) == key))
            return _bind(last, lambda at: from_line(at, ends))

        all_keys = F.array(*[F.lit(key) for key in P.ANSWER_KEYS])
        return _bind(
            F.filter(positions, ends_value),
            lambda ends: F.transform(all_keys, lambda key: value(key, ends)),
        )

    def mark(lines: Column) -> Column:
        keys = F.transform(lines, lambda line: F.regexp_extract(line, key_of, 1))
        marked = F.struct(keys.alias("keys"), F.transform(lines, strip).alias("texts"))
        return _bind(marked, lambda m: read(lines, m))

    # The explode keeps later filters from repeating the parse in their conditions.
    parsed = blocks.select("*", F.explode(F.array(_bind(F.split("block", LINE_END), mark))).alias("_values"))
    return parsed.select(
        *blocks.columns, *[F.get("_values", F.lit(i)).alias(key) for i, key in enumerate(P.ANSWER_KEYS)]
    )


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _bad_integer(c: Column, kind: str = "int") -> Column:
    """No integer, or one beyond ``kind``."""
    return c.isNotNull() & _integer(c, kind).isNull()


def _integer(c: Column, kind: str) -> Column:
    return F.when(strip(c).rlike(INTEGER), F.replace(strip(c), F.lit("_"), F.lit(""))).try_cast(kind)


def type_results(fields: DataFrame) -> DataFrame:
    """Typed answer per block, or its ``error``."""
    f = {k: F.col(k) for k in P.ANSWER_KEYS}
    scored, filtered = f["STATUS"] == "SCORED", f["STATUS"] == "FILTERED"
    missing = lambda key: F.format_string(P.MISSING_FIELD, F.lit(key), F.col("block"))
    missing_of = lambda key, kind: F.format_string(P.MISSING_FIELD_OF, F.lit(key), F.lit(kind), F.col("block"))
    not_int = lambda c: F.format_string(P.BAD_INTEGER, c)
    error = (
        F.when(f["JOB_ID"].isNull(), missing("JOB_ID"))
        .when(_bad_integer(f["JOB_ID"], "bigint"), not_int(f["JOB_ID"]))
        .when(f["STATUS"].isNull(), missing("STATUS"))
        .when(filtered & f["REASON"].isNull(), missing_of("REASON", "FILTERED"))
        .when(scored & f["SCORE"].isNull(), missing_of("SCORE", "SCORED"))
        .when(scored & _bad_integer(f["SCORE"]), not_int(f["SCORE"]))
        .when(scored & _bad_integer(f["REQS_MATCH"]), not_int(f["REQS_MATCH"]))
        .when(scored & _bad_integer(f["DOMAIN_MATCH"]), not_int(f["DOMAIN_MATCH"]))
        .when(scored & f["REASONING"].isNull(), missing_of("REASONING", "SCORED"))
        .when(~scored & ~filtered, F.format_string(P.UNKNOWN_STATUS, f["STATUS"], F.col("block")))
    )
    only_scored = lambda c: F.when(scored, c)
    or_default = lambda key, text: only_scored(F.coalesce(f[key], F.lit(text)))
    or_zero = lambda key: only_scored(F.coalesce(_integer(f[key], "int"), F.lit(0)))
    return fields.select(
        "batch",
        "block_pos",
        _integer(f["JOB_ID"], "bigint").alias("job_id"),
        F.when(scored, "scored").when(filtered, "filtered").alias("result_type"),
        F.when(filtered, f["REASON"]).alias("reason"),
        only_scored(_integer(f["SCORE"], "int")).alias("score"),
        or_zero("REQS_MATCH").alias("requirements_match"),
        or_zero("DOMAIN_MATCH").alias("domain_match"),
        only_scored(f["REASONING"]).alias("reasoning"),
        or_default("GAPS", P.DEFAULT_GAPS).alias("gaps"),
        or_default("HARD_REQUIREMENTS", P.DEFAULT_LIST).alias("hard_requirements"),
        or_default("PREFERRED_REQUIREMENTS", P.DEFAULT_LIST).alias("preferred_requirements"),
        only_scored(parse_address(f["ADDRESS"])).alias("address"),
        error.alias("error"),
    )


def last_block(typed: DataFrame) -> DataFrame:
    """The last answer per job id of a batch."""
    latest = F.max_by(F.struct(*PAYLOAD), "block_pos").alias("r")
    return (
        typed.where(F.col("job_id").isNotNull()).groupBy("batch", "job_id").agg(latest)
        .select("batch", "job_id", "r.*")
    )


def missing_ids(expected: DataFrame, typed: DataFrame) -> DataFrame:
    """Positions of ``expected`` (batch, pos) for which the batch has no answer."""
    answered = typed.select("batch", F.col("job_id").alias("pos"))
    return expected.select("batch", "pos").join(answered, ["batch", "pos"], "left_anti")


def batch_status(typed: DataFrame, expected: DataFrame, responses: DataFrame) -> DataFrame:
    """``error`` per answered batch: the scorer's own, the first bad block, or missing ids."""
    bad = (
        typed.where(F.col("error").isNotNull())
        .groupBy("batch")
        .agg(F.min_by("error", "block_pos").alias("_block_error"))
    )
    gaps = (
        missing_ids(expected, typed)
        .groupBy("batch")
        .agg(F.array_join(F.array_sort(F.collect_list("pos")).cast("array<string>"), ", ").alias("_ids"))
        .select("batch", F.format_string(P.MISSING_RESULTS, "_ids").alias("_gap_error"))
    )
    own = F.col("error") if "error" in responses.columns else F.lit(None).cast("string")
    return (
        responses.select("batch", own.alias("_own_error"))
        .join(bad, "batch", "left")
        .join(gaps, "batch", "left")
        .select("batch", F.coalesce("_own_error", "_block_error", "_gap_error").alias("error"))
    )


def isolate_failures(expected: DataFrame, last: DataFrame, status: DataFrame) -> DataFrame:
    """One result per expected position of an answered batch; a bad batch fails as a whole."""
    by_pos = last.withColumnRenamed("job_id", "pos")
    joined = expected.select("batch", "pos").join(status, "batch").join(by_pos, ["batch", "pos"], "left")
    ok = F.col("error").isNull()
    payload = [F.when(ok, F.col(c)).alias(c) for c in PAYLOAD if c not in ("result_type", "reason")]
    return joined.select(
        "pos",
        F.when(ok, F.col("result_type")).otherwise("failed").alias("result_type"),
        F.when(ok, F.col("reason")).otherwise(F.col("error")).alias("reason"),
        *payload,
    )


def reassemble(listings: DataFrame, results: DataFrame) -> DataFrame:
    """Listings with their result; a listing without one has failed."""
    none = F.col("result_type").isNull()
    return (
        listings.join(results, "pos", "left")
        .withColumn("reason", F.when(none, P.MISSING_FROM_WORKER).otherwise(F.col("reason")))
        .withColumn("result_type", F.coalesce("result_type", F.lit("failed")))
    )


def join_results(listings: DataFrame, results: DataFrame) -> DataFrame:
    """Listings and results by position; rows without a partner drop out."""
    return listings.join(results, "pos")


def parse_responses(responses: DataFrame, expected: DataFrame) -> DataFrame:
    """Results by position from the answers; ``expected`` has (batch, pos)."""
    typed = type_results(parse_fields(split_blocks(responses))).repartition("batch")
    return isolate_failures(expected, last_block(typed), batch_status(typed, expected, responses))
