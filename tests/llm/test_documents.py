"""Document operators against brute force on small tables with nulls, empties, repeats and clashing names."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftline.llm.components import connected_components
from siftline.llm.mixing import find_exponent, mix_sources
from siftline.llm.multiset import delete, edited_fingerprints, insert, with_lanes
from siftline.llm.packing import OpenBins, WordTokenizer, pack, pack_documents, sequences, token_pieces
from siftline.llm.queries import TOKENIZER
from siftline.llm.simhash import keep_one, simhash_groups
from siftline.llm.suffixes import Windows, _bytes_of, _gram_lists, _shared_grams, _suffixes, merge_runs, remove_repeats

WORDS = "the of and river stone über ça lantern, quiet. Field's moss 42 — naïve\tgreen\nbright".split(" ")
# Names that operators use inside must not clash with columns of the caller.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, chunk int, fp bigint, part int, row string"


def corpus(seed=3, n=60):
    rnd = random.Random(seed)
    shared = " ".join(rnd.choice(WORDS) for _ in range(40))
    texts = []
    for i in range(n):
        own = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 80)))
        kind = i % 6
        if kind == 0 and texts:
            own = rnd.choice(texts)
        elif kind == 1:
            own += shared[rnd.randint(0, 30):] + own[:20]
        elif kind == 2 and texts:
            own = rnd.choice(texts) + " end"
        texts.append(own)
    texts += ["", " \n\t ", "x", "ab" * 90, "ab" * 120, "é" * 70, "é" * 60, "long " * 3000]
    rows = [(i * 3 - 7, t, "en", f"s{i % 3}", len(t), 1, 2, 3, "r") for i, t in enumerate(texts)]
    return rows + [(500, None, None, None, None, None, None, None, None), (None, texts[4], "fr", "s0", 1, 1, 1, 1, "r"), rows[5]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def order(i):
    return -(2**63) if i is None else i


def simhash_of(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(docs, nothing):
    rows = corpus()
    prints = [simhash_of(r[1]) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            group[i] = min(group[j] for j, b in enumerate(prints) if (a ^ b).bit_count() <= 2)
    least = [min((rows[j][0] for j in range(len(rows)) if group[j] == g), key=order) for g in group]
    want = sorted(((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, least)), key=str)
    got = sorted((tuple(r) for r in simhash_groups(docs).collect()), key=str)
    assert got == want
    assert simhash_groups(nothing).count() == 0
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=order) == sorted({w[2] for w in want}, key=order)
    assert keep_one(nothing).count() == 0


def test_keep_one_of_equal_ids(spark):
    rnd = random.Random(4)
    texts = [" ".join(f"{rnd.randrange(10**6)}" for _ in range(40)) for _ in range(30)]
    rows = [(None if i % 3 else 5, t, "en", "s", 1, 1, i, 3, "r") for i, t in enumerate(texts)]
    copies = [(9, *r[1:]) for r in rows] + [(8, texts[0] + " ", *rows[0][2:]), rows[3], rows[4]]
    kept = keep_one(spark.createDataFrame(rows + copies, SCHEMA).repartition(3))
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted(rows, key=str)


def test_simhash_links_two_bits(spark):
    from siftline.llm.simhash import links

    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(20)]
    fps = {b ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for b in base for _ in range(30)} | set(base)
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    for bits in (1, 2):
        found = connected_components(links(spark.createDataFrame(signed, "fp bigint"), bits))
        label = {r.node % 2**64: r.component for r in found.collect()}
        group = {f: f for f in fps}
        for _ in range(8):
            group = {f: min((group[g] for g in fps if (f ^ g).bit_count() <= bits)) for f in fps}
        sizes = sorted(list(group.values()).count(g) for g in set(group.values()) if list(group.values()).count(g) > 1)
        assert sizes == sorted(list(label.values()).count(c) for c in set(label.values()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 300), (300, 200), (7, 7), (100, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 300: 100}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("length, chunk, hot", [
    (50, 1500, 1 << 16), (50, 1 << 20, 1 << 16), (8, 4000, 1 << 16), (90, 2000, 1 << 16),
    (50, 1500, 0), (50, 1500, 12), (8, 4000, 40), (90, 2000, 3),
])
def test_remove_repeats(docs, length, chunk, hot):
    rows = corpus()
    least = {}
    for r in rows:
        body = (r[1] or "").encode()
        for i in range(len(body) - length + 1):
            key = body[i : i + length]
            least[key] = min(least.get(key, r[0]), r[0], key=order)
    want = []
    for r in rows:
        body = (r[1] or "").encode()
        gone = bytearray(len(body))
        for i in range(len(body) - length + 1):
            if order(least[body[i : i + length]]) < order(r[0]):
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(body, gone) if not g)
        spans = len([s for s in bytes(gone).split(b"\0") if s])
        want.append((r[0], len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest(), r[8]))
    got = remove_repeats(docs, length, ("row",), chunk_bytes=chunk, hot_anchor=hot).drop("kept")
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("hot, spread", [(1 << 16, False), (64, True)])
def test_a_phrase_of_many_documents_is_spread(hot, spread):
    """One phrase among different words: its suffixes share a part, unless its anchors count as hot."""
    rnd, w, parts, key = random.Random(4), Windows(50), 16, (pa.scalar(0, pa.int32()),)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    texts = [f"{word(40)} the same phrase in all of them {word(40)}" for _ in range(2000)]
    table = pa.table({"doc_id": pa.array(range(2000), pa.int64()), "text": texts})
    lists = _gram_lists(parts, w)(key, table)
    shared = pa.concat_tables([
        _shared_grams(hot)((pa.scalar(p, pa.int32()),), rows) for p in range(parts)
        if (rows := lists.filter(pa.array(lists["part"].to_numpy() == p))).num_rows
    ])
    s = _suffixes(*_bytes_of(table), table["doc_id"].to_numpy(), shared, parts, w)
    sizes = np.bincount(s.part, minlength=parts)
    assert (sizes.max() < 1.2 * sizes.mean()) == spread
    assert spread or sizes.max() > 1000


def test_remove_repeats_of_nothing(nothing):
    assert remove_repeats(nothing).count() == 0


def test_merge_runs():
    rnd = random.Random(2)
    common = lambda a, b: next((i for i in range(9) if a[i] != b[i]), 9)
    for k in range(1, 9):
        runs = [sorted(bytes(rnd.choice(b"ab") for _ in range(9)) for _ in range(rnd.randint(0, 25))) for _ in range(k)]
        known = [[0] + [common(a, b) for a, b in zip(r, r[1:])] for r in runs]
        of, shared = merge_runs(runs, known, 9)
        heads = [iter(r) for r in runs]
        merged = [next(heads[i]) for i in of]
        assert merged == sorted(sum(runs, []))
        assert shared[1:] == [common(a, b) for a, b in zip(merged, merged[1:])]


def test_pack_documents(docs, nothing):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    packed = pack_documents(docs, TOKENIZER, 256, open_bins=4, with_ids=True)
    want = []
    for r in corpus():
        ids = np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(r[0], i // 256, i, len(ids[i : i + 256]), zlib.crc32(ids[i : i + 256].tobytes())) for i in range(0, len(ids), 256)]
    rows = packed.collect()
    assert sorted((tuple(r[:5]) for r in rows), key=str) == sorted(want, key=str)
    full = {r.sequence_id: len(r.ids) // 4 for r in sequences(packed).collect()}
    assert max(full.values()) <= 256
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for seq, pieces in by.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == full[seq]
    assert len(full) <= 1.2 * sum(w[3] for w in want) / 256 + 4
    assert pack_documents(nothing, TOKENIZER).count() == 0


@pytest.mark.parametrize("part_rows", [1 << 16, 40])
def test_sequences_follow_an_order(spark, part_rows):
    """Ranges of the order are packed one after the other; a repeated text stands where its own place is."""
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice(WORDS) for _ in range(60)) if i % 4 else "the same again " * 12, (i * 37) % 400) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, at bigint").repartition(5)
    pieces = token_pieces(docs, TOKENIZER, 256, place=F.col("at"))
    got = pack(pieces, 256, 4, part_rows, order="place").collect()
    assert sorted(r.doc_id for r in got if r.piece == 0) == list(range(400)) and all(r.place == r.doc_id * 37 % 400 for r in got)
    filled, turns = {}, {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
        turns.setdefault(r.sequence_id, []).append(r.place)
    for places in filled.values():
        ends = [0, *np.cumsum([n for _, n in sorted(places)])]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 256
    means = [np.mean(turns[q]) for q in sorted(turns)]
    assert np.corrcoef(means, range(len(means)))[0, 1] > 0.99
    assert np.median([max(t) - min(t) for t in turns.values()]) < 40  # an open bin may wait long for a piece that fits


def test_tokenizer_forgets():
    tokenizer, small = Tokenizer.from_file(TOKENIZER), WordTokenizer(TOKENIZER, most_words=3)
    for text in ("one two three", "four one", "three two one four five", "one", "naïve <|endoftext|> x", "Ωmega ΟΔΟΣ two", "can't 12", "a\x00b \x7f\x1f", "\x85\xadß\xa0"):
        assert np.frombuffer(small.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_best_fit():
    bins = OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 10, 8, 4)] == [(0, 0), (1, 0), (1, 7), (2, 0), (3, 0), (0, 6)]
    bins.clear()
    assert [bins.place(n) for n in (6, 7, 8, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6)]  # 8 closes the fuller bin 1
    assert bins.open == 1


def test_pack_refuses(spark):
    with pytest.raises(Exception, match="does not fit"):
        pack(spark.createDataFrame([(1, 11)], "doc_id bigint, length bigint"), 10).collect()


def test_edited_fingerprints(spark, docs, nothing):
    rows = sorted(corpus(), key=lambda r: (order(r[0]), r[1] or ""))
    want = []
    for i, r in enumerate(rows):
        text, after = r[1] or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest()))
    got = edited_fingerprints(docs).collect()
    assert sorted((tuple(r[:3]) for r in got), key=str) == sorted(want, key=str)
    texts = {r[0]: r[1] or "" for r in rows}
    prints = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault(r.fingerprint, set()).add(" ".join(sorted(texts[r.doc_id].split())))
    assert all(len(x) == 1 for x in prints.values())
    assert edited_fingerprints(nothing).count() == 0
    one = edited_fingerprints(spark.createDataFrame([(5, "one. two.")], "doc_id bigint, text string")).first()
    assert (one.near_next, one.edited_sha256) == (1.0, hashlib.sha256(b"one. one.").hexdigest())


def test_lanes_add_up(spark):
    df = spark.createDataFrame([("b one\nc two\na three", "c two\nb one", "a three", "a three\nb one\nc two")], "abc string, bc string, a string, shuffled string")
    for c in ("abc", "bc", "a", "shuffled"):
        df = with_lanes(df, c, f"{c}_lanes")
    row = df.select(
        "abc_lanes", "shuffled_lanes", "bc_lanes", insert(F.col("bc_lanes"), F.col("a_lanes")).alias("plus"),
        delete(F.col("abc_lanes"), F.col("a_lanes")).alias("minus"),
    ).first()
    assert row.abc_lanes == row.shuffled_lanes == row.plus != row.bc_lanes == row.minus


def test_mixing(spark, docs, nothing):
    sources = spark.createDataFrame([(1000,), (100,), (10,)], "tokens bigint")
    # Repetition is (t / t_max)^(a - 1): for the least source 100^(1 - a) = 4.
    assert abs(find_exponent(sources, repeat_limit=4.0).exponent - (1 - np.log(4) / np.log(100))) < 1e-6
    mix = find_exponent(sources, entropy=0.9)
    w = np.array([1000, 100, 10.0]) ** mix.exponent
    w /= w.sum()
    assert abs(-(w * np.log(w)).sum() - 0.9) < 1e-5
    assert find_exponent(sources, entropy=9.0).exponent == 0 and find_exponent(sources, repeat_limit=1.0).exponent == 1
    rows = mix_sources(docs, repeat_limit=2.0, block_tokens=500).select("doc.*", "copy", "tokens", "start", "block", "weight").collect()
    given = corpus()
    first = sorted((tuple(r[:9]) for r in rows if r.copy == 0), key=str)
    assert first == sorted(given, key=str)
    for source in {r[3] for r in given}:
        mine = sorted((r for r in rows if r.source == source), key=lambda r: (r.start, r.tokens))
        have = sum(-(-len((g[1] or "").encode()) // 4) for g in given if g[3] == source)
        at = 0
        for r in mine:
            assert r.start == at and r.block == int(r.start / max(1.0, r.weight * 500))
            at += r.tokens
        assert have <= at <= 2 * have + max((r.tokens for r in mine), default=0)
    assert mix_sources(nothing, repeat_limit=2.0).count() == 0


def test_rows_of_one_id_are_spread(spark):
    """A third of null ids, and one id for many texts: rows of an id leave each other's passages alone, in any chunk."""
    passage = "a passage of more than fifty bytes that stands in very many rows of the table; "
    rows = [(None, f"{i} {passage}{i * 7}") for i in range(40)] + [(5, f"five {i} {passage}") for i in range(40)]
    rows += [(9 + i, f"own {i * 31} text without the rest") for i in range(40)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), 50, chunk_bytes=512).collect()
    assert len(got) == 120
    by_id = lambda wanted: {(r.n_removed > 0, r.n_spans) for r in got if wanted(r.doc_id)}
    assert by_id(lambda i: i is None) == {(False, 0)}
    assert by_id(lambda i: i == 5) == {(True, 1)}
    assert by_id(lambda i: i is not None and i >= 9) == {(False, 0)}
