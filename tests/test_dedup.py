"""The blocked match against a nested loop."""

import random

import pytest
from pyspark.sql import functions as F

from siftline.functions.similarity import _lcs
from siftline.operators import dedup as D

LISTING = "pos bigint, company string, title string, description string"
STORED = "seq bigint, company string, title string, description string, url string, first_seen date"

COMPANIES = ["Stripe Inc.", "stripe payments", "Google", "google cloud LLC", "Costco", "", "Acme Technologies Inc."]
TITLES = ["Data Engineer", "Engineer, Data", "Data  Engineer II", "Staff Engineer", "data engineer.", "Nurse"]


def changed(rng, text, share):
    chars = list(text)
    for _ in range(int(len(text) * share)):
        at = rng.randint(0, len(chars))
        if chars and rng.random() < 0.5:
            chars.pop(min(at, len(chars) - 1))
        else:
            chars.insert(at, rng.choice("abcxyz é"))
    return "".join(chars)


def fixture():
    rng = random.Random(7)
    words = ["data", "team", "café", "build", "and", "the", "of", "systems", "x", "remote"]
    texts = ["", "", "a", "ab", "same text", "Same Text"]
    for n in [1, 2, 3, 5, 6, 8, 11, 15, 17, 20, 22, 25, 40, 60, 100]:
        base = " ".join(rng.choice(words) for _ in range(n))
        texts.append(base)
        for share in [0.0, 0.01, 0.02, 0.04, 0.05, 0.06, 0.1, 0.2]:
            texts.append(changed(rng, base, share))
            texts.append(base[: int(len(base) * (1 - share))])
    rows = [(rng.choice(COMPANIES), rng.choice(TITLES), t) for t in texts]
    rng.shuffle(rows)
    half = len(rows) // 2
    new = [(i, *r) for i, r in enumerate(rows[:half] + rows[half : half + 20])]
    stored = [(100 + i, *r, f"u{i}", None) for i, r in enumerate(rows[half:] + rows[half : half + 10])]
    return new, stored


def ratio(a, b):
    total = len(a) + len(b)
    return 100.0 if not total else 100 * (1 - (total - 2 * _lcs(a, b)) / total)


def token_set(a, b):
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    sect, x, y = (" ".join(sorted(s)) for s in (left & right, left - right, right - left))
    if sect and (not x or not y):
        return 100.0
    with_x, with_y = (" ".join(p for p in (sect, rest) if p) for rest in (x, y))
    distance = len(x) + len(y) - 2 * _lcs(x, y)
    best = 100 - 100 * distance / (len(with_x) + len(with_y))
    return max(best, ratio(sect, with_x), ratio(sect, with_y)) if sect else best


def nested_loop(new, stored, forms, thresholds):
    """First match by comparing every pair."""
    out = {}
    for pos, company, title, text in new:
        for seq, s_company, s_title, s_text, _, _ in sorted(stored):
            a, b = forms[company, title], forms[s_company, s_title]
            company_score = 100.0 if a[0] == b[0] else token_set(a[0], b[0])
            if company_score < thresholds.company:
                continue
            title_score = ratio(" ".join(sorted(a[1].split())), " ".join(sorted(b[1].split())))
            if title_score < thresholds.title:
                continue
            score = ratio(text.lower(), s_text.lower())
            if score >= thresholds.description:
                out[pos] = (seq, company_score, title_score, score)
                break
    return out


@pytest.fixture(scope="module")
def data(spark):
    new, stored = fixture()
    n, s = spark.createDataFrame(new, LISTING), spark.createDataFrame(stored, STORED)
    named = n.select("company", "title").union(s.select("company", "title")).distinct()
    forms = {
        (r.company, r.title): (r.n_company, r.n_title)
        for r in D.with_keys(named.withColumn("description", F.lit(""))).collect()
    }
    return new, stored, n, s, forms


@pytest.mark.parametrize("threshold", [0, 50, 85, 91.5, 92, 95, 97, 99, 100])
def test_against_nested_loop(data, threshold):
    new, stored, n, s, forms = data
    thresholds = D.Thresholds(50, 80, threshold)
    want = nested_loop(new, stored, forms, thresholds)
    got = {
        r.pos: (r.matched_seq, r.company_score, r.title_score, r.description_score)
        for r in D.find_matches(n, s, thresholds).collect()
    }
    assert {p: v[0] for p, v in got.items()} == {p: v[0] for p, v in want.items()}
    for pos, v in got.items():
        assert v[1:] == pytest.approx(want[pos][1:])
    assert len(want) > 5


@pytest.mark.parametrize("company, title", [(0, 0), (100, 100), (70, 50)])
def test_other_thresholds(data, company, title):
    new, stored, n, s, forms = data
    thresholds = D.Thresholds(company, title, 95)
    want = nested_loop(new, stored, forms, thresholds)
    got = {r.pos: r.matched_seq for r in D.find_matches(n, s, thresholds).collect()}
    assert got == {p: v[0] for p, v in want.items()}


@pytest.mark.parametrize("threshold", [85, 95])
def test_slices_of_the_store(data, threshold, monkeypatch):
    new, stored, n, s, forms = data
    monkeypatch.setattr(D, "FIRST_SLICE", 8)
    monkeypatch.setattr(D, "SLICE_GROWTH", 4)
    thresholds = D.Thresholds(50, 80, threshold)
    assert len(D._slices(s)) == 3
    want = nested_loop(new, stored, forms, thresholds)
    got = {r.pos: r.matched_seq for r in D.find_matches(n, s, thresholds).collect()}
    assert got == {p: v[0] for p, v in want.items()}


def test_new_and_details(data):
    new, stored, n, s, forms = data
    fresh, matches = D.deduplicate(n, s)
    details = D.match_details(matches, s).collect()
    assert {r.pos for r in fresh.collect()} | {r.pos for r in details} == {r[0] for r in new}
    assert fresh.count() + len(details) == len(new)
    assert all(r.matched_first_seen == "" and r.matched_url.startswith("u") for r in details)


def test_self_duplicates_stay(spark):
    n = spark.createDataFrame([(0, "a", "t", "same"), (1, "a", "t", "same")], LISTING)
    fresh, matches = D.deduplicate(n, spark.createDataFrame([], STORED))
    assert fresh.count() == 2 and matches.count() == 0


def test_candidates_against_nested_loop(data):
    new, stored, n, s, forms = data
    got = {
        (r.n_company, r.n_title, r.s_company, r.s_title): (r.company_score, r.title_score)
        for r in D.fuzzy_candidates(n, s).collect()
    }
    want = {}
    for a in {forms[r[1], r[2]] for r in new}:
        for b in {forms[r[1], r[2]] for r in stored}:
            company = 100.0 if a[0] == b[0] else token_set(a[0], b[0])
            title = ratio(" ".join(sorted(a[1].split())), " ".join(sorted(b[1].split())))
            if company >= 50 and title >= 80:
                want[a + b] = (company, title)
    assert got.keys() == want.keys()
    for key, v in got.items():
        assert v == pytest.approx(want[key])


def test_tiers_leave_no_gap():
    for threshold in [91, 91.5, 92, 93, 95, 97, 98.5, 99, 99.9]:
        tiers = D.piece_tiers(threshold)
        if not tiers:
            continue
        share = 2 * (1 - threshold / 100) / (threshold / 100)
        for n in range(0, 3000):
            edits = int(share * n + 1e-9)
            p = next((p for from_length, p in tiers if n >= from_length), None)
            assert (n // p > edits) if p else edits == 0, (threshold, n)


@pytest.mark.parametrize("threshold", [60, 70, 80, 90, 100])
def test_title_index_against_all_pairs(spark, threshold):
    rng = random.Random(threshold)
    words = ["data", "engineer", "senior", "ii", "a", "xx", "aaaa", "manager", "ëé", "of"]
    titles = {"", "a", "ab", "aaaaaaaaaaaa", "aaaaaaaaaaab"}
    for _ in range(150):
        title = " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))
        titles |= {title, changed(rng, title, 0.1).strip(), changed(rng, title, 0.25).strip()}
    titles = sorted(titles)
    ours, theirs = titles[::2], titles[1::2] + titles[:20]
    frame = lambda rows, name: spark.createDataFrame([(t,) for t in rows], f"{name} string")
    got = {(r.n_title, r.s_title): r.title_score for r in D.similar_titles(frame(ours, "n_title"), frame(theirs, "s_title"), threshold).collect()}
    by_words = lambda t: " ".join(sorted(t.split()))
    want = {(a, b): ratio(by_words(a), by_words(b)) for a in ours for b in theirs}
    want = {k: v for k, v in want.items() if v >= threshold}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    assert len(want) >= 10


def test_title_index_meets_few_strangers(spark):
    """The index must not pair most titles of a dictionary with each other."""
    made = {}
    for n in (500, 2000):
        rng = random.Random(n)
        titles = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24)) for _ in range(n)]
        frame = lambda name: spark.createDataFrame([(t,) for t in titles], f"{name} string")
        made[n] = D.title_pairs(frame("n_sorted"), frame("s_sorted"), 80).count()
    assert made[500] < 500 * 500 / 4 and made[2000] < 2000 * 2000 / 4
