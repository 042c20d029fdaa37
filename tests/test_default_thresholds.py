"""The duplicate report and two runs at the default thresholds, over whole tables, against a nested loop."""

import os
import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from checks.tables import Tables
from siftline.operators import dedup as D
from test_dedup import nested_loop

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
DEFAULT = D.Thresholds(50, 80, 95)


@pytest.fixture(scope="module")
def tables(spark):
    t = Tables(spark, SF)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = t.listings.select("pos", *[text(c) for c in ("company", "title", "description")]).collect()
    keyed = D.with_keys(t.listings.select("company", "title").distinct().withColumn("description", F.lit("")))
    forms = {(r.company, r.title): (r.n_company, r.n_title) for r in keyed.collect()}
    return t, {r.pos: tuple(r) for r in rows}, forms


def matches(new, stored, forms):
    return nested_loop(new, [(*r, None, None) for r in stored], forms, DEFAULT)


def test_dup_report(spark, tables):
    t, listings, forms = tables
    stored = [tuple(r) for r in t.stored.select("seq", "company", "title", "description").collect()]
    want = matches(list(listings.values()), stored, forms)
    got = queries()["dup_report"](spark, SF).orderBy("pos").collect()
    assert [r.pos for r in got] == sorted(want) and [r.n for r in got] == list(range(1, len(got) + 1))
    for r in got:
        scores = [int(x) for x in re.findall(r": (\d+) of 100", r.fragment)]
        assert scores == pytest.approx(want[r.pos][1:], abs=0.501)


def test_two_runs(spark, tables):
    t, listings, forms = tables
    labelled = {r.doc_id for r in t.labels.collect()}
    first = [v for k, v in listings.items() if k in labelled]
    known = matches(list(listings.values()), first, forms)
    rows = queries()["incremental_two_runs"](spark, SF).select("run_id", "url").collect()
    pos = lambda run: sorted(int(re.search(r"currentJobId=(\d+)", r.url)[1]) for r in rows if r.run_id == run)
    assert pos(1) == sorted(r[0] for r in first)
    assert pos(2) == sorted(set(listings) - set(known))
    assert set(known) >= {r[0] for r in first}
