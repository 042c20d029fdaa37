"""Decontamination, conversation trie and whitening against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm.decontaminate import decontaminate
from siftline.llm.trie import conversation_trie
from siftline.llm.whitening import contour_eigenpairs, eigenvalues_above, leading_eigenpairs, split_spectrum, whiten

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- decontamination ----------------------------------------------------------------------------------------


def words_of(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def contaminated(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        for i in range(max(len(w) - 9, min(len(w), 1))):
            windows[tuple(w[i : i + 10])].add(item)
    out = []
    for doc, text in docs:
        w, hit, named = words_of(text), set(), set()
        for i in range(len(w)):
            for n in range(1, 11):
                found = windows.get(tuple(w[i : i + n])) if i + n <= len(w) else None
                if found:
                    hit |= set(range(i, i + n))
                    named |= found - {None}
        ids = ",".join(sorted(map(str, named)))
        out.append((doc, len(w), len(hit), len(named), sha(ids), bool(hit)))
    return sorted(out, key=repr)


def prose(rnd, n, vocabulary=400):
    return " ".join(f"{rnd.choice('abcdeéXYZ')}{rnd.randrange(vocabulary)}{rnd.choice([',', '.', '', '', ' -'])}" for _ in range(n))


def cases(seed=5):
    rnd = random.Random(seed)
    items = [(i, prose(rnd, rnd.choice([3, 7, 9, 10, 11, 25, 60]))) for i in range(40)]
    items += [(7, prose(rnd, 30)), (None, prose(rnd, 14)), (90, None), (91, " ... "), (92, items[6][1]), (93, "Zebra!"), (94, "a1 a1 a1 a1 a1 a1 a1 a1 a1 a1 a1 a1")]
    docs = []
    for i in range(120):
        parts = [prose(rnd, rnd.randrange(0, 60))]
        for _ in range(rnd.randrange(3)):
            w = rnd.choice(items)[1] or ""
            cut = w.split()
            a = rnd.randrange(len(cut) + 1)
            parts += [" ".join(cut[a : a + rnd.randrange(5, 30)]).upper(), prose(rnd, rnd.randrange(12))]
        docs.append((i, "\n".join(parts)))
    docs += [(3, docs[3][1]), (None, docs[4][1]), (None, None), (500, ""), (501, "a1 " * 300), (502, "zebra"), (503, "xéÉ \x7f a")]
    docs += [(504 + i, items[41][1]) for i in range(30)]
    return docs, items


def told(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=repr)


@pytest.mark.parametrize("bits", [1 << 23, 64])
def test_decontaminate(spark, bits):
    docs, items = cases()
    d = spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id long, text string, key string, hits int").repartition(5)
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, window int")
    assert told(decontaminate(d, b, bits=bits)) == contaminated(docs, items)


def test_decontaminate_pieces_of_long_texts(spark):
    rnd = random.Random(1)
    passage, long_word = prose(rnd, 40), "w" * 5000
    text = " ".join([prose(rnd, 3000), passage, long_word, prose(rnd, 2000), passage.upper(), "tail"])
    docs, items = [(1, text), (2, "short"), (3, passage), (4, long_word * 3)], [(1, passage), (2, "tail"), (3, prose(rnd, 8))]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = contaminated(docs, items)
    for segment in (300, 1000, 1 << 22):
        assert told(decontaminate(d, b, segment=segment)) == want
    huge = " ".join(["v" * 20, *["y"] * 600_000, passage])
    (row,) = decontaminate(spark.createDataFrame([(1, huge)], "doc_id long, text string"), b).collect()
    assert (row.n_words, row.n_hit, row.n_items) == (600_001 + 40, 40, 1)


def test_decontaminate_empty_tables(spark):
    none, some = (spark.createDataFrame(r, "doc_id long, text string") for r in ([], [(1, "a b")]))
    items = spark.createDataFrame([], "item_id long, text string")
    assert told(decontaminate(none, items)) == []
    assert told(decontaminate(some, items)) == [(1, 2, 0, 0, sha(""), False)]


# --- conversation trie --------------------------------------------------------------------------------------


def trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:3])] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children, saved, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, m in members.items():
        if path:
            children[path[:-1]] += 1
    for path, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(m) - 1) * words
            leaves[path[:d]] += path not in children
    out = []
    for path, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(m), len(path), parent, len(m), children[path], leaves[path], saved[path], sha(ends)))
    return sorted(out, key=repr)


def talks(seed=2, n=400):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(n), -3, -20, -41, 2**62]:
        if c % 37 == 0 and c:
            continue
        for turn in range(rnd.choice([0, 1, 2, 3, 5, 8])):
            text = rnd.choice(["hello there", "a  b\tc", "", None, f"own {rnd.randrange(40)}"])
            rows.append((c, turn if rnd.random() > 0.05 else None, ["user", "assistant", None][turn % 3], text))
    rows += [(1000 + i, t, "user", f"hot {t}") for i in range(300) for t in range(4)]
    rows += [(2000, t, "user", f"deep {t}") for t in range(200)] + [(2020, t, "user", f"deep {t}") for t in range(150)]
    rows += [(None, 0, "user", "nobody"), (41, 1, "user", "twice"), (41, 1, "user", "twice")]
    rows += [(7, 1, "user", "tie"), (7, 1, "assistant", "tie")]
    return rows


def nodes(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("shard_turns", [1 << 18, 300, 25])
def test_trie(spark, shard_turns):
    rows = [(c, t, r, x, "p", 1) for c, t, r, x in talks()]
    # Ties of turn and role differ in text only: not here, their order is by digest.
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string, shard int").repartition(4)
    seen = {}
    kept = [r for r in rows if seen.setdefault((r[0], r[1], r[2] or ""), r[3] or "") == (r[3] or "")]
    df = spark.createDataFrame(kept, df.schema).repartition(4)
    assert nodes(conversation_trie(df, shard_turns)) == trie([r[:4] for r in kept])


def test_trie_hot_copies_and_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert nodes(conversation_trie(spark.createDataFrame([], schema))) == []
    rows = [(20 * i + 1, 0, "user", "w " * 50_000) for i in range(5000)] + [(5, None, None, None)]
    df = spark.createDataFrame([(i, t, r, "w " * 50 if i != 5 else x) for i, t, r, x in rows], schema).repartition(4)
    want = trie([(i, t, r, "w " * 50 if i != 5 else x) for i, t, r, x in rows])
    assert nodes(conversation_trie(df, 700)) == want
    one = spark.createDataFrame([rows[0]], schema)
    assert nodes(conversation_trie(one)) == trie(rows[:1])
    # Of 5 with h turns of an absent base, nothing may be left but the root.
    lone = spark.createDataFrame([(2, 0, "user", "x")], schema)
    assert nodes(conversation_trie(lone)) == trie([(2, 0, "user", "x")])


# --- whitening ----------------------------------------------------------------------------------------------


def whitened(rows, most=8):
    usable = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) and abs(c) < 2**40 for c in v)]
    lengths = [len(v) for _, v in usable]
    d = max(sorted(set(lengths)), key=lengths.count, default=0)
    usable = [(i, [int(np.floor(1024 * c)) + 100_000 for c in v]) for i, v in usable if len(v) == d]
    n = len(usable)
    sums = [sum(v[j] for _, v in usable) for j in range(d)]
    away = np.array([[(n * v[j] - sums[j]) / n for j in range(d)] for _, v in usable])
    e, vectors = np.linalg.eigh(away.T @ away / n)
    order = np.argsort(-e)[:most]
    white = away @ vectors[:, order] / np.sqrt(e[order])
    deviation = [sum((n * v[j] - sums[j]) ** 2 for j in range(d)) for _, v in usable]
    return [i for i, _ in usable], deviation, white, e[order] / e.sum(), n


def check_whitening(df, rows, most=8):
    ids, deviation, white, explained, n = whitened(rows, most)
    got = defaultdict(dict)
    for r in df.collect():
        got[r.component].setdefault(r.vec_id, []).append(r)
    assert sorted(got) == list(range(1, white.shape[1] + 1))
    for c, of_ids in got.items():
        mine = {i: (dev, w) for i, dev, w in zip(ids, deviation, white[:, c - 1])}
        assert sum(map(len, of_ids.values())) == n
        sign = np.sign(sum(r[0].whitened * mine[i][1] for i, r in of_ids.items()))
        for i, found in of_ids.items():
            for r in found:
                assert r.n == n and r.identity_error <= 1e-6 and abs(r.explained / explained[c - 1] - 1) < 1e-9
                assert r.deviation == mine[i][0] and abs(r.whitened * sign - mine[i][1]) < 1e-7


def test_whitening(spark):
    rng = np.random.default_rng(3)
    data = rng.standard_normal((700, 24)) * np.linspace(2, 0.1, 24)
    rows = [(int(i), v.tolist()) for i, v in enumerate(data)]
    rows += [(700, None), (701, []), (702, [None] * 24), (703, [float("nan")] * 24), (704, [float("inf")] + [0.0] * 23), (705, [1.0] * 5), (None, [0.5] * 24)]
    rows += [(706, [1e30] + [0.0] * 23)] + [(800 + i, [0.25] * 24) for i in range(300)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, x int, n int").repartition(5)
    check_whitening(whiten(df), rows)
    check_whitening(whiten(df, 3), rows, 3)


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 9):
        assert whiten(spark.createDataFrame(rows, schema)).collect() == []
    rng = np.random.default_rng(1)
    low = [(i, [float(a), float(b), float(a), 1.0]) for i, (a, b) in enumerate(rng.integers(-4, 5, (200, 2)))]
    got = whiten(spark.createDataFrame(low, schema)).collect()
    assert {r.component for r in got} == {1, 2} and got[0].identity_error < 1e-9  # the rank is two
    big = [(i, [float(2**38 * i), float(i % 7)]) for i in range(60)]
    assert {r.deviation for r in whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>"), 1).collect()} == {None}


def test_contour_and_inertia():
    rng = np.random.default_rng(7)
    for d, values in ((40, np.geomspace(1, 1e-6, 40)), (30, np.r_[[5.0] * 12, np.linspace(1, 0.1, 18)]), (12, np.r_[3.0, [1.0] * 11]), (1, np.array([2.0]))):
        q, _ = np.linalg.qr(rng.standard_normal((d, d)))
        m = q * values @ q.T
        m = (m + m.T) / 2
        for bound in (-1.0, 0.05, 0.5, 0.999, 2.0, 6.0):
            assert eigenvalues_above(m, bound) == (values > bound).sum()
        intervals = split_spectrum(m, 16, 8)
        assert sum(i.count for i in intervals) >= min(8, d)
        for i in intervals:
            found, vectors = contour_eigenpairs(m, i)
            assert len(found) == i.count and np.abs(m @ vectors - vectors * found).max() < 1e-11
        found, vectors = leading_eigenpairs(m, 8)
        assert np.abs(found - np.sort(values)[::-1][:8]).max() < 1e-11 and np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-12
    indefinite = np.array([[0.0, 1.0], [1.0, 0.0]])
    assert eigenvalues_above(indefinite, 0.0) == 1 and eigenvalues_above(np.zeros((3, 3)), 0.0) == 0


# --- multiset fingerprints over any ids ---------------------------------------------------------------------


def edited(rows):
    """(id, edited text) by sorting all rows."""
    rows = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], (r[1] or "").encode()))
    texts = [r[1] or "" for r in rows]
    cut = lambda t, nxt: t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
    return sorted(((r[0], sha(cut(t, texts[(i + 1) % len(texts)]))) for i, (r, t) in enumerate(zip(rows, texts))), key=repr)


@pytest.mark.parametrize("case", ["hashes", "ends", "outlier", "null", "one id"])
def test_next_document_for_any_ids(spark, monkeypatch, case):
    from siftline.llm import multiset

    monkeypatch.setattr(multiset, "BUCKET_ROWS", 100)
    rnd = random.Random(len(case))
    texts = [" ".join(rnd.choice("abcdefgh") * 3 for _ in range(rnd.randrange(30))) for _ in range(1500)]
    ids = {
        "hashes": [rnd.randrange(-(2**63) + 1, 2**63) for _ in texts],
        "ends": [-(2**63) + 1, 2**63 - 1, 0] * 500,
        "outlier": [2**62, *range(1499)],
        "null": [None if i % 3 else i for i in range(1500)],
        "one id": [7] * 1500,
    }[case]
    rows = list(zip(ids, texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = multiset.edited_fingerprints(df).select("doc_id", "edited_sha256").collect()
    assert sorted(((r.doc_id, r.edited_sha256) for r in got), key=repr) == edited(rows)


def test_likeness_against_the_cosine_of_paragraph_counts(spark):
    from collections import Counter

    from siftline.llm import multiset

    rnd = random.Random(9)
    rows = [(i, "\n".join(f"p{rnd.randrange(60)}" for _ in range(rnd.randrange(1, 80)))) for i in range(200)]
    got = {r.doc_id: r.near_next for r in multiset.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    bags = [Counter(t.split("\n")) for _, t in rows]
    cosine = lambda a, b: sum(a[k] * b[k] for k in a) / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
    errors = [abs(got[i] - cosine(bags[i], bags[(i + 1) % 200])) for i in range(200)]
    assert sum(errors) / 200 < 0.09 and max(errors) < 0.4
