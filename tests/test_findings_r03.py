"""Findings of the third review: each test failed before its finding was mended."""

import hashlib
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import checks.scoring  # noqa: F401
from checks.registry import QUERIES
from checks.state import user_source
from checks.tables import Tables
from siftline.functions.similarity import _lcs
from siftline.operators import dedup as D, report, scoring, texts
from test_dedup import changed

MATCHES = (
    "pos bigint, matched_seq bigint, matched_company string, matched_title string, matched_description string, matched_url string, "
    "matched_first_seen string, company_score double, title_score double, description_score double"
)


def test_user_source_of_several_files(spark, tmp_path):
    """a table is a folder of files as soon as Spark has written it."""
    rows = [(i, f"text {i}" if i % 5 else None, "en", "web", 6) for i in range(30)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    documents.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = user_source(Tables(spark, str(tmp_path))).collect()
    assert sorted(r.description for r in found) == sorted(r[1] or "" for r in rows)
    assert {(r.title, r.company, r.source) for r in found} == {("en", "web", "documents_board")}


def test_prompts_reach_python_in_small_batches(spark):
    """a prompt holds whole listings, so a task must not get 10,000 of them at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    prompts = spark.range(300).select(F.col("id").alias("batch"), F.concat(F.lit("p"), F.col("id")).alias("prompt"))

    def scorer(prompt):
        if prompt.endswith("7"):
            raise ValueError(prompt)
        return prompt.upper()

    answers = scoring.score_batches(prompts, scorer, 2)
    assert spark.conf.get(key) == "2000"
    got = {r.batch: (r.response, r.error) for r in answers.collect()}
    assert got == {i: (None, f"p{i}") if i % 10 == 7 else (f"P{i}", None) for i in range(300)}


def test_duplicates_are_numbered_without_their_texts(spark, monkeypatch):
    """a block of positions has a million rows, so it must not hold the texts of both sides."""
    seen = []
    real = report.number_rows
    monkeypatch.setattr(report, "number_rows", lambda df, *a, **k: seen.append(df.columns) or real(df, *a, **k))
    new = spark.createDataFrame(
        [(p, f"t{p}", "c", "u", "d") for p in (5, 2, 2, 9)], "pos bigint, title string, company string, url string, description string"
    )
    matches = spark.createDataFrame([(p, p, "c", "t", "d", "u", "", 100.0, 100.0, 100.0) for p in (9, 2, 5)], MATCHES)
    got = sorted((r.n, r.pos) for r in report.dup_report(new, matches).collect())
    assert got == [(1, 2), (2, 2), (3, 5), (4, 9)]
    assert seen == [["pos"]]


def _texts(spark, rows, name):
    keyed = spark.createDataFrame([(i, "c", "t", t) for i, t in rows], f"{name} bigint, company string, title string, description string")
    return D.distinct_texts(D.with_keys(keyed), name, "nid" if name == "pos" else "sid")


def _score(a, b):
    return 100 * (1 - (len(a) + len(b) - 2 * _lcs(a, b)) / (len(a) + len(b)))


@pytest.mark.parametrize("threshold", [92, 95, 99])
def test_cells_against_all_pairs(spark, monkeypatch, threshold):
    """F1 to F10: all links between different texts, with small chunks, several shares, copies and frequent texts."""
    monkeypatch.setattr(D, "FREQUENT", 3)
    monkeypatch.setattr(texts, "CHUNK", 1 << 12)
    rng = random.Random(threshold)
    pool = []
    for n in [3, 20, 40, 58, 63, 64, 65, 70, 101, 104, 300, 900]:
        for _ in range(4):
            base = "".join(rng.choice("abcde é") for _ in range(n))
            pool += [base, base] + [changed(rng, base, share) for share in (0.01, 0.03, 0.05, 0.07)]
    pool += ["frequent text of some thirty marks"] * 9 + ["ab" * 200, "ab" * 196, "ab" * 205 + "c"]
    rng.shuffle(pool)
    new, stored = list(enumerate(pool)), list(enumerate(pool[::-1]))[::2]
    first = lambda rows: {t: min(i for i, u in rows if u == t) for t in {t for _, t in rows}}
    ours, theirs = first([(i, t.lower()) for i, t in new]), first([(i, t.lower()) for i, t in stored])
    want = {(ours[a], theirs[b]): s for a in ours for b in theirs if a != b and (s := _score(a, b)) >= threshold}
    got = D.similar_texts(_texts(spark, new, "pos"), _texts(spark, stored, "seq"), threshold).collect()
    assert {(r.nid, r.sid): r.description_score for r in got} == pytest.approx(want) and len(got) == len(want) > 20


def test_grams_are_not_shuffled(spark):
    """what is shuffled to find similar texts are texts: a row per text and chunk, not per gram or pair."""
    rows = [(i, f"{i:04d} " + "the same words in every text " * 20) for i in range(200)]
    found = D.similar_texts(_texts(spark, rows, "pos"), _texts(spark, rows, "seq"), 95)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "posexplode" not in plan
    assert found.count() == 200 * 199


def test_low_thresholds_begin_with_few_stored_rows(spark, monkeypatch):
    """every listing finds its match in the first few rows, so later slices are not searched."""
    seen = []
    real = D.match_variants
    monkeypatch.setattr(D, "match_variants", lambda n, s, t: seen.append(s.count()) or real(n, s, t))
    new = spark.createDataFrame([(i, "c", "t", f"a listing {i:03d}") for i in range(40)], "pos bigint, company string, title string, description string")
    stored = new.select(F.col("pos").alias("seq"), "company", "title", F.concat("description", F.lit(".")).alias("description"))
    matches = D.find_matches(new, stored.unionByName(stored.withColumn("seq", F.col("seq") + 2000)), D.Thresholds(50, 80, 60)).collect()
    assert {(r.pos, r.matched_seq) for r in matches} == {(i, 0) for i in range(40)}
    assert seen == [8]


class Teller:
    """Answers with the number of prompts that it has had and a digest of all of them."""

    def __init__(self):
        self.seen, self.digest = 0, ""

    def __call__(self, prompt):
        self.seen += 1
        self.digest = hashlib.sha256((self.digest + prompt).encode()).hexdigest()
        if prompt.endswith("5"):
            raise ValueError(f"{self.seen} {self.digest}")
        return f"{self.seen} {self.digest}"


def _told(rows):
    """(batch, response, error) of each row of (batch, conversation, prompt), every conversation asked in order by one scorer."""
    tellers, got = {}, []
    for batch, conversation, prompt in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        teller = tellers.setdefault(conversation, Teller())
        try:
            got.append((batch, teller(prompt), None))
        except ValueError as e:
            got.append((batch, None, str(e)))
    return sorted(got, key=str)


@pytest.mark.parametrize("tasks", [1, 4])
def test_long_conversations_go_in_turns(spark, monkeypatch, tasks):
    """a task reads a part of a conversation, and the scorer goes on with what it knows; gaps, null keys and a late conversation."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    monkeypatch.setattr(scoring, "TURN_BLOCK", 4)
    turns, real = [], scoring._turns
    monkeypatch.setattr(scoring, "_turns", lambda told, *a: turns.append((told, real(told, *a))) or turns[-1][1])
    rows = [(b, b % 3, "x" * 100_000 + str(b)) for b in range(60) if not 20 < b < 30] + [(70, 7, "late 70"), (71, 7, None), (72, 0, "end")]
    rows += [(None, None, "no batch"), (1 << 40, None, "far away")]
    prompts = spark.createDataFrame(rows, "batch bigint, conversation bigint, prompt string")
    want = _told([r for r in rows if r[2] is not None])
    answered = scoring.score_batches(prompts, Teller(), tasks, turn_mb=1)
    got = sorted([tuple(r) for r in answered.collect()], key=str)
    assert [r for r in got if r[0] != 71] == want and len(got) == len(rows)
    ((told, parts),) = turns
    assert len(parts) >= 3
    for part in parts:
        task = F.pmod(F.hash("conversation"), F.lit(tasks))
        most = told.where(part).groupBy(task).agg(F.sum("_size").alias("size")).agg(F.max("size")).first()[0]
        assert most <= (1 << 20) + 4 * 100_010
    assert sum(told.where(p).count() for p in parts) == len(rows)


def test_short_conversations_are_one_turn(spark):
    """nothing is handed on, so a scorer need not be picklable after use; keys are kept; no prompts give no rows."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = [(b, b % 2, f"p{b}") for b in range(9)]
    prompts = spark.createDataFrame(rows, "batch bigint, conversation bigint, prompt string").withColumn("key", F.concat(F.lit("k"), "batch"))
    holds = []
    scorer = lambda prompt: holds.append(open("/dev/null")) or prompt.upper()
    got = scoring.score_batches(prompts, scorer, 2, keep=("key",), turn_mb=1).collect()
    assert sorted(map(tuple, got)) == [(f"k{b}", f"P{b}", None) for b in range(9)]
    assert scoring.score_batches(prompts.limit(0), scorer, 2, turn_mb=1).count() == 0


def test_query_asks_long_conversations_in_turns(spark, tmp_path, monkeypatch):
    """the query itself goes in turns, with the rows of one turn."""
    text = "some words of a long listing " * 2000
    rows = [(i, f"{i} {text}" if i % 7 else None, "en" if i % 2 else None, "web", 6) for i in range(90)] + [(5, "twice", "de", "web", 5)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    query = lambda: sorted(map(tuple, QUERIES["score_batches"](spark, str(tmp_path)).collect()), key=str)
    want = query()
    turns, real = [], scoring._turns
    monkeypatch.setattr(scoring, "TURN_MB", 1)
    monkeypatch.setattr(scoring, "TURN_BLOCK", 1)
    monkeypatch.setattr(scoring, "_turns", lambda *a: turns.append(real(*a)) or turns[-1])
    assert query() == want and len(want) == len(rows) and len(turns[0]) > 1
