"""Archives, URL lists, languages, quality, vectors and the pipeline on small tables."""

import base64
import datetime as dt
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import connect, difference, spark_rows, sql_rows
from siftline.llm import queries, sql
from siftline.llm.embeddings import near_vectors, table_plan
from siftline.llm.language import Evidence, identify
from siftline.llm.quality import fit_rules, lasso_logistic, score_quality, statistics
from siftline.llm.urlfilter import filter_captures, validity
from siftline.llm.warc import scan_warc, warc_round_trip, write_warc

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
QUOTED = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
PAGES = "page_id bigint, url string, html string, block string, path string, rel int"


def pages():
    rows = [(i, f"http://a.example/{i}", f"<p>{i % 7}ä</p>" * (i % 5 * 40), "b", "p", 1) for i in range(60)]
    rows += [(100 + i, None, f"start{QUOTED}middle{QUOTED}WARC/1.0\r\n{'z' * 900}{i % 2}", "b", "p", 1) for i in range(6)]
    return rows + [(200, "a b\r\nc", None, None, None, None), (201, "", "", "b", "p", 1), (202, "u", "WARC/1.0\r\n", "b", "p", 1)]


@pytest.mark.parametrize("least, split", [(0, "128m"), (200, "1k")])
def test_warc_round_trip(spark, least, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc_round_trip(spark.createDataFrame(pages(), PAGES).repartition(3), least).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    first, want = {}, []
    for r in sorted(pages()):
        body = (r[2] or "").encode()
        same = first.setdefault(body, r[0])
        revisit = same != r[0] and len(body) >= least
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want.append((r[0], len(body), digest, "revisit" if revisit else "response", same if revisit else None))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_warc_revisits_of_one_id(spark):
    rows = [(i, None, html * 9, "b", "p", 1) for html in ("one", "three", "fifth") for i in (None, None, 7, 8)] + [(7, None, "own", "b", "p", 1), (9, None, "own", "b", "p", 1)]
    got = warc_round_trip(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    want = []
    for r in rows:
        first = 7 if r[2] == "own" else None
        told = r[0] is not None and r[0] != first
        digest = base64.b32encode(hashlib.sha1(r[2].encode()).digest()).decode()
        want.append((r[0], len(r[2]), digest, "revisit" if told else "response", first if told else None))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_warc_of_nothing_and_broken(spark, tmp_path):
    assert warc_round_trip(spark.createDataFrame([], PAGES)).count() == 0
    path = str(tmp_path / "w")
    write_warc(spark.createDataFrame(pages(), PAGES).coalesce(1), path)
    name = next(p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-"))
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc").write_bytes(name.read_bytes()[:-7])
    with pytest.raises(ValueError, match="does not end"):
        scan_warc(spark, str(tmp_path / "cut"))


def test_url_lists(spark):
    day = lambda n: dt.date(2024, 1, n)
    entries = [
        ("l1", "host", "a.example", "add", day(5)), ("l1", "host", "a.example", "remove", day(10)),
        ("l1", "host", "a.example", "add", day(20)), ("l1", "host", "a.example", "remove", day(20)),
        ("l2", "domain", "example", "add", day(1)), ("l2", "domain", "b.example", "add", day(3)),
        ("l3", "url", "c.org/x/y", "add", day(2)), ("l3", "prefix", "c.org/x", "add", day(8)), (None, "host", "c.org", "add", day(1)),
    ]
    entries = spark.createDataFrame(entries, "list string, kind string, pattern string, action string, day date")
    spans = {tuple(r) for r in validity(entries).collect()}
    assert ("l1", "host", "a.example", day(5), day(10)) in spans and len(spans) == 5
    captures = [
        (1, "http://A.example/p", day(5)), (2, "http://a.example:80/", day(10)), (3, "http://x.b.example/", day(4)),
        (4, "http://c.org/x/y?q#f", day(9)), (5, "http://c.org/x/y", day(1)), (6, None, day(9)), (7, "not a url", day(9)),
        (8, "http://c.org/x/z", None), (None, "http://c.org/x/", day(8)), (4, "http://c.org/x/y?q#f", day(9)),
    ]
    extra = [(*c, "k", 1) for c in captures]
    got = filter_captures(spark.createDataFrame(extra, "page_id bigint, url string, day date, kind string, n int"), entries).collect()
    want = [
        (1, day(5), 1, True, "l1", "host"), (2, day(10), 0, False, None, None), (3, day(4), 1, True, "l2", "domain"),
        (4, day(9), 2, True, "l3", "url"), (4, day(9), 2, True, "l3", "url"), (5, day(1), 0, False, None, None),
        (6, day(9), 0, False, None, None), (7, day(9), 0, False, None, None), (8, None, 0, False, None, None), (None, day(8), 1, True, "l3", "prefix"),
    ]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    none = filter_captures(spark.createDataFrame(extra, "page_id bigint, url string, day date, kind string, n int"), entries.limit(0))
    assert none.count() == len(captures) and none.where("blocked").count() == 0


def test_url_lists_of_all_depths(spark):
    day = dt.date(2024, 1, 1)
    patterns = [("prefix", p) for p in ("c.org/x/y", "c.org/x/y/", "c.org/x/y/z/w", "d.org/", "e.org/a/")] + [("domain", "example"), ("domain", "b.test")]
    entries = spark.createDataFrame([("l", *p, "add", day) for p in patterns], "list string, kind string, pattern string, action string, day date")
    urls = {
        "http://c.org/x/y/z": 2, "http://c.org/x/y/z/w/v?q": 3, "http://c.org/x/yy": 0, "http://c.org/x": 0, "http://c.org/x/y": 1,
        "http://d.org/p/q/r": 1, "http://d.org": 1, "http://d.org/": 1, "http://e.org/a": 0, "http://e.org/a/": 1, "http://e.org/a/b": 1,
        "http://x.b.example/p": 0, "http://example/p": 1, "http://a.x.b.test/p": 1, "http://b.test.org/p": 0,
    }
    captures = spark.createDataFrame([(i, u, day) for i, u in enumerate(urls)], "page_id bigint, url string, day date")
    got = {r.page_id: r.n_entries for r in filter_captures(captures, entries).collect()}
    assert got == dict(enumerate(urls.values()))


def test_language(spark):
    en = "the quick thing that was with them and then there thought through "
    fr = "les choses que nous avons dans cette ville où elle était pour toujours "
    rows = [(i, (en if i % 2 else fr) * 6, "en" if i % 2 else "fr", "http://www.h.fr/" if i % 2 == 0 else "http://h.uk/") for i in range(40)]
    rows += [(50, en * 6, "fr", "http://h.uk/"), (51, fr * 6, None, None), (52, "", "fr", "http://www.h.fr/a"), (53, None, None, None), (54, "12 34 %% " * 50, None, "http://h.uk/"), (None, fr * 300, "xx-YY", "z"), (2, *rows[2][1:])]
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], "doc_id bigint, text string, lang string, url string, n int, host string")
    got = identify(df, Evidence(markup="lang", url="url", languages=("en", "fr"))).select("row.doc_id", "language", "posterior", "kept").collect()
    assert len(got) == len(rows)
    said = {r.doc_id: r for r in got}
    assert all(said[i].language == ("en" if i % 2 else "fr") and said[i].kept for i in range(40))
    assert said[50].language == "en" and said[51].language == "fr" and said[52].language == "fr" and said[None].language == "fr"
    assert all(0 < r.posterior <= 1 for r in got)
    assert identify(df.limit(0), Evidence(markup="lang", url="url")).count() == 0


def test_rules():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(2000, 3))
    y = ((x[:, 0] > 0.6) & (x[:, 1] <= 0.5)).astype(float)
    model = fit_rules(x, y, ["a", "b", "c"])
    z = model.intercept + sum(w * r.holds(x) for r, w in zip(model.rules, model.weights))
    assert ((z > 0) == (y == 1)).mean() > 0.98
    assert len(fit_rules(x, y, ["a", "b", "c"], penalty=0.02).rules) < len(model.rules)
    assert fit_rules(x[:0], y[:0], ["a", "b", "c"]).rules == [] == fit_rules(x, y * 0, ["a", "b", "c"]).rules
    assert np.allclose(lasso_logistic(x, y, 10.0)[1], 0)


def test_quality_edges(spark):
    docs = [(i, ("good text here. " if i % 3 else "### %%% ") * (i % 9 + 3), "x", 1.0) for i in range(300)] + [(900, None, "x", 1.0), (901, "", "x", 1.0), (None, "good text", "x", 1.0), (4, "good text here. " * 9, "x", 1.0)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, quality string, capitals double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    got = score_quality(docs, labels).collect()
    assert len(got) == 304 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    import zlib

    held = [r for r in got if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r in held) and np.mean([(r.score > 0.5) == (r.doc_id % 3 > 0) for r in held]) > 0.95
    assert score_quality(docs.limit(0), labels).count() == 0
    assert score_quality(docs, labels.limit(0)).select("score").distinct().count() == 1


def test_repeats_of_long_texts(spark):
    import re

    texts = ["same " * 100_000, "- - - -" * 3000, "a a a b b a\n\na", " \t lead  lead x", "ab a ab ab", "x", "", " ", "é é\u00a0é é", "end end "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.repeats for r in df.select("doc_id", statistics(F.col("text"))["repeats"].alias("repeats")).collect()}
    for i, text in enumerate(texts):
        words = list(re.finditer(r"[^ \t\n\x0b\f\r]+", text))
        gone = sum(b.end() - a.end() for a, b in zip(words, words[1:]) if a.group() == b.group())
        assert abs(got[i] - gone / max(1, len(text))) < 1e-12, text[:20]
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id bigint, quality int")
    assert score_quality(df, labels).count() == len(texts)


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((12, 16))
    vecs = [c + rng.standard_normal(16) * s for c in centre for s in rng.uniform(0, 0.35, 12)]
    vecs += [vecs[0], vecs[0] * 1e200, vecs[1] * -1, np.zeros(16)]
    rows = [(i * 2, [float(x) for x in v], "l", 1) for i, v in enumerate(vecs)]
    rows += [(901, None, "l", 1), (903, [], "l", 1), (905, [None] * 16, "l", 1), (907, [float("nan")] * 16, "l", 1), (909, [float("inf")] + [1.0] * 15, "l", 1), (911, [1.0, 2.0], "l", 1), (913, [2.0, 4.0], "l", 1), rows[3]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, cls string, n int")
    good = [(r[0], np.array(r[1], float) / np.abs(np.array(r[1], float)).max()) for r in rows if r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    near = lambda a, b: len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95 - 1e-12
    links = {i: [j for j, (_, b) in enumerate(good) if j != i and near(a, b)] for i, (_, a) in enumerate(good)}
    label = {i: good[i][0] for i in links}
    for _ in range(30):
        label = {i: min([label[i], *(label[j] for j in links[i])]) for i in links}
    want = [(good[i][0], len(links[i]), label[i], good[i][0] == label[i]) for i in links]
    told = [i for i, _ in good]
    want += [(r[0], 0, r[0], True) for r in rows if r[0] not in told]
    got = near_vectors(df, 0.95).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert near_vectors(df.limit(0)).count() == 0
    assert table_plan(10**9, 0.95)[0] > table_plan(10**3, 0.95)[0]


@needs_tables
@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_sql(spark, name):
    ours = spark_rows(queries.QUERIES[name](spark, SF))
    assert ours[1] and difference(ours, sql_rows(connect(SF), sql.SQL[name])) is None


@needs_tables
def test_mixing_counts_tokens(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op1_mix_sources(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert all(r.tokens == len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids) + 1 for r in rows)


@needs_tables
def test_quality_is_learnt(spark):
    scored = queries.op7_quality(spark, SF.replace("0.001", "0.01")).join(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet"), "doc_id")
    held = scored.where("held_out").select(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert held > 0.95


@needs_tables
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_extra", F.lit(1))
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == columns, name
        left = {r.doc_id for r in after.select("doc_id").collect()}
        assert left <= ids and len(left) > 0.8 * len(ids), name
        if name in ("repeats", "mix"):
            assert left == ids
        docs, ids = after, left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids
    assert corpus_pipeline.run(spark, SF).count() == packed.count()
