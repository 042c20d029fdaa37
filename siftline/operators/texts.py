"""Similar texts of two tables, found and compared in cells of like length.

A text that may match another one has nearly its length. So new texts are dealt to cells of neighbouring lengths, each to
one, and stored texts go to the cells in their reach. One task reads a cell: it holds the new texts and searches
them in the stored ones, a chunk of these after the other. No piece, gram or pair of texts is shuffled: what goes over the network are the
texts, new ones once and stored ones as often as there are cells in their reach. Inside a chunk

- stored texts of at most 64 characters make a tree for each length, in which a common beginning (or end) is compared with a new text
  once for all texts that have it, and is left as soon as it has more edits than a match may have;
- longer stored texts are cut into pieces (see ``siftline.operators.dedup``). The pieces that most texts of the chunk have are left
  out, as many as a match can do without, and new texts look up all their grams among the others, by letters and place.
  Pairs that share enough pieces are compared many at a time (``siftline.functions.subsequence``).

No step is approximate.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftline.functions.subsequence import codes_of, lcs_many
from siftline.session import small_batches

SHORT = 64
# Characters of the new texts of a cell, and of the stored texts of a chunk, at most unless one text alone has more; what a text costs besides them.
CHUNK, COST = 3 << 24, 256
# Length buckets for each factor e, and characters of new texts that are looked up at a time.
FINE, GROUP = 256, 1 << 18
# Coincidences of grams and pieces, or pairs of short texts, that are looked at a time.
AT_ONCE = 1 << 20
# New texts that go through a tree at a time.
SLICE = 1 << 14
# Letters of a short stored text after which the first ones of a longer new text are out of reach.
TURN = 36
# The bits of a key that are a place, in characters; the others are a hash.
_PLACE = np.uint64((1 << 28) - 1)
_ALL = ~np.uint64(0)
_ODD = np.random.default_rng(11).integers(1 << 62, size=16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` code points from each place on."""
    n = max(0, len(codes) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h += codes[k : k + n].astype(np.uint64) * _ODD[k]
    return _mixed(h)


def _mixed(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(29))) * _ODD[0]


def _groups(rows: np.ndarray, lengths: np.ndarray, size: int = GROUP) -> list[np.ndarray]:
    """``rows`` in runs of about ``size`` characters, so that little is held beside the texts."""
    return np.split(rows, np.flatnonzero(np.diff(np.cumsum(lengths) // size)) + 1)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number from 0 within it) of ``counts[i]`` rows of every i."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class Tree:
    """Stored texts of one length of at most 64 characters as a tree of their beginnings, or of their ends if these are fewer."""

    def __init__(self, at: np.ndarray, texts: list[str], letters: np.ndarray) -> None:
        self.size = len(texts[0])
        ways = []
        for backwards in (False, True):
            turned = [t[::-1] for t in texts] if backwards else texts
            order = np.array(sorted(range(len(texts)), key=turned.__getitem__), np.int64)
            read = codes_of([turned[i] for i in order])[0].reshape(len(texts), self.size)
            differ = read[1:] != read[:-1]
            same = np.where(differ.any(axis=1), differ.argmax(axis=1), self.size)
            ways.append((int((self.size - same).sum()), backwards, order, read, same))
        _, self.backwards, order, read, same = min(ways, key=lambda w: w[0])
        self.at = at[order]
        self.read = np.searchsorted(letters, read).astype(np.uint16 if len(letters) < 1 << 16 else np.int32)
        # At each depth the first text of every node, and which nodes of the next depth are its children.
        self.starts = [np.zeros(1, np.int64)]
        for depth in range(1, self.size + 1):
            begin = np.append(0, np.flatnonzero(same < depth) + 1)
            self.starts.append(begin if len(begin) > len(self.starts[-1]) else self.starts[-1])
        self.children = [None if a is b else np.searchsorted(b, np.append(a, len(texts))) for a, b in zip(self.starts, self.starts[1:])]

    def search(self, texts: np.ndarray, size: int, edits: int, letters: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row of ``texts``, stored text, common subsequence) within ``edits`` of each other; the rows hold ``size`` letters each.

        A bit for each letter of a row is cleared as it extends a common subsequence. Two texts differ on the way by no more edits than in all,
        if the way is measured where their rests have the lengths' difference left.
        """
        if self.backwards:
            texts = texts[:, ::-1]
        behind = max(0, size - 64)  # letters that are out of reach when the last ones come into it
        marks = [np.zeros((len(texts), letters + 1), np.uint64) for _ in range(2)]
        for k in range(size):
            for table, bit in zip(marks, (k, k - behind)):
                if 0 <= bit < 64:
                    table[np.arange(len(texts)), texts[:, k]] |= np.uint64(1 << bit)
        for table in marks:
            table[:, letters] = 0
        marks = [table.ravel() for table in marks]
        n = len(texts)
        stack = [(0, np.arange(n), np.zeros(n, np.int64), np.full(n, _ALL), np.zeros(n, np.int64))]
        while stack:
            depth, x, node, row, before = stack.pop()
            while depth < self.size and x.size:
                if x.size > AT_ONCE:
                    half = x.size // 2
                    stack.append((depth, x[half:], node[half:], row[half:], before[half:]))
                    x, node, row, before = x[:half], node[:half], row[:half], before[:half]
                if self.children[depth] is not None:
                    first = self.children[depth][node]
                    owner, nth = _spread(self.children[depth][node + 1] - first)
                    x, node, row, before = x[owner], first[owner] + nth, row[owner], before[owner]
                late = depth >= TURN
                hit = row & marks[late].take(x * (letters + 1) + self.read[self.starts[depth + 1][node], depth], mode="clip")
                row = (row + hit) | (row ^ hit)
                depth += 1
                if depth == TURN and behind:
                    before = before + np.bitwise_count(~row & np.uint64((1 << behind) - 1))
                    row = row >> np.uint64(behind) | ~(_ALL >> np.uint64(behind))
                end = max(0, depth + size - self.size)
                own = end - behind if depth >= TURN else end
                lcs = before + np.bitwise_count(~row & np.uint64((1 << own) - 1))
                ok = depth + size - self.size + depth - 2 * lcs <= edits
                if not ok.all():
                    x, node, row, before, lcs = x[ok], node[ok], row[ok], before[ok], lcs[ok]
            if x.size:
                yield x, self.at[self.starts[self.size][node]], lcs


class Chunk:
    """The stored texts of a cell, in the order of their ids, ready to be searched."""

    def __init__(self, ids: list[int], forms: list, texts: list[str], threshold: float, tiers: list[tuple[int, int]], first_only: bool) -> None:
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        self.loss, self.threshold, self.first_only = 1 - threshold / 100, threshold, first_only
        self.ids = np.array(ids, np.int64)[order]
        known: dict[str, int] = {}
        self.forms = np.array([-1 if forms[i] is None else known.setdefault(forms[i], len(known)) for i in order], np.int64)
        self.texts = [texts[i] for i in order]
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        short = np.flatnonzero(self.lengths <= SHORT)
        self.letters = np.unique(codes_of([self.texts[i] for i in short])[0])
        self.trees = []
        for size in np.unique(self.lengths[short]).tolist():
            at = short[self.lengths[short] == size]
            self.trees.append(Tree(at, [self.texts[i] for i in at], self.letters))
        self._cut(np.flatnonzero(self.lengths > SHORT), tiers)

    def edits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.floor(self.loss * (a + b) + 1e-6).astype(np.int64)

    def _cut(self, long: np.ndarray, tiers: list[tuple[int, int]]) -> None:
        """Index the pieces of the ``long`` texts, without the commonest ones of each, by their letters and their place."""
        self.pieces = np.zeros(len(self.texts), np.int64)  # of a text
        self.left_out = np.zeros(len(self.texts), np.int64)
        self.index = []
        size = np.zeros(len(self.texts), np.int64)
        for from_length, p in reversed(tiers):
            size[self.lengths >= from_length] = p
        for p in np.unique(size[long]):
            if p == 0:  # so short that a match allows no edit
                continue
            own = long[size[long] == p]
            n = self.lengths[own] // p
            blocks = _groups(own, self.lengths[own], GROUP * 8)
            h = np.concatenate([self._piece_hashes(part, p) for part in blocks])
            known = np.sort(h)
            begins = np.flatnonzero(np.append(True, known[1:] != known[:-1]))
            known, often = known[begins], np.diff(np.append(begins, len(h))).astype(np.int32)
            del begins
            # A match with the longest partner keeps n - edits pieces; most of these need not be indexed.
            reach = self.lengths[own] * (2 / (1 - self.loss))
            spare = np.maximum(0, (n - np.floor(self.loss * reach + 1e-6).astype(np.int64)) * 3 // 4)
            self.pieces[own], self.left_out[own] = n, spare
            keys, texts, done = [], [], 0
            for part in blocks:
                text, piece = _spread(self.pieces[part])
                hashes = h[done : done + len(text)]
                done += len(text)
                order = np.lexsort((-often[np.searchsorted(known, hashes)], text))
                kept = order[piece >= self.left_out[part][text]]
                texts.append(part[text[kept]].astype(np.int32))
                keys.append(hashes[kept] & ~_PLACE | np.minimum(piece[kept].astype(np.uint64) * np.uint64(p), _PLACE))
            del h, known, often
            key, text = np.concatenate(keys), np.concatenate(texts)
            del keys, texts
            order = np.argsort(key)
            self.index.append(Index(int(p), key[order], text[order], self.lengths[own], self.loss))

    def _piece_hashes(self, part: np.ndarray, p: int) -> np.ndarray:
        """Hashes of the pieces of some texts, one text after the other."""
        codes, starts = codes_of([self.texts[i] for i in part])
        text, piece = _spread(self.lengths[part] // p)
        at = starts[text] + piece * p
        return _mixed(sum(codes[at + k].astype(np.uint64) * _ODD[k] for k in range(p)))

    def search(self, ids: list[int], texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(new id, stored id, score) of different texts that reach the threshold.

        With ``first_only``, pairs of a new text and any but the first one of the stored texts of equal company and title may be left out.
        """
        lengths = np.array([len(t) for t in texts], np.int64)
        own = np.array(ids, np.int64)
        for x, j, lcs in self._found(texts, lengths):
            total = lengths[x] + self.lengths[j]
            score = 100 * (1 - (total - 2 * lcs) / total)
            ok = (score >= self.threshold) & (2 * lcs < total)
            x, j, score = x[ok], j[ok], score[ok]
            if self.first_only and len(x):
                first = self._firsts(x, j)
                x, j, score = x[first], j[first], score[first]
            if len(x):
                yield own[x], self.ids[j], score

    def _found(self, texts: list[str], lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(new text, stored text, length of their common subsequence) of all pairs within the edits that the threshold allows."""
        if self.trees:
            yield from self._search_short(texts, lengths)
        if not self.index:
            return
        held, n = [], 0
        for part in _groups(np.arange(len(texts)), lengths):
            held.append(self._candidates(part, texts, lengths))
            n += len(held[-1][0])
            if n > AT_ONCE:
                yield from self._compared(texts, lengths, *map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield from self._compared(texts, lengths, *map(np.concatenate, zip(*held)))

    def _firsts(self, x: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether a pair is the first one of its new text and stored company and title; texts of several of these always are."""
        form = np.where(self.forms[j] < 0, -1 - j, self.forms[j])
        order = np.lexsort((j, form, x))
        first = np.ones(len(x), bool)
        same = (x[order][1:] == x[order][:-1]) & (form[order][1:] == form[order][:-1])
        first[order[1:][same]] = False
        return first

    def _candidates(self, part: np.ndarray, texts: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(new text, stored text) pairs that share enough pieces at places that fit."""
        codes, starts = codes_of([texts[i] for i in part])
        found = []
        for index in self.index:
            for x, entry, place in index.coincidences(codes, starts, lengths[part]):
                j, k = index.text[entry].astype(np.int64), (index.key[entry] & _PLACE).astype(np.int64) // index.p
                a, b = lengths[part[x]], self.lengths[j]
                edits = self.edits(a, b)
                # So many characters are inserted, less those deleted, before the place.
                ahead = k * index.p - place
                ok = (2 * ahead <= edits + b - a) & (-2 * ahead <= edits - b + a) & (np.abs(a - b) <= edits)
                pair = x[ok] * len(self.texts) + j[ok]
                found.append(_distinct(pair << 24 | k[ok]) if len(entry) >= AT_ONCE // 2 else pair << 24 | k[ok])
        every = np.concatenate(found) if found else np.empty(0, np.int64)
        if not every.size:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        # First by all places where a piece is found, then each piece counts once for a pair.
        for distinct in (False, True):
            pair, at, shared = _counted(_distinct(every) >> 24 if distinct else every >> 24, len(part) * len(self.texts))
            x, j = pair // len(self.texts), pair % len(self.texts)
            needed = self.pieces[j] - self.edits(lengths[part[x]], self.lengths[j]) - self.left_out[j]
            enough = shared >= np.maximum(1, needed)
            if not distinct:
                every = every[enough[at]]
        return part[x[enough]], j[enough]

    def _compared(self, texts: list[str], lengths: np.ndarray, x: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Compare pairs; with ``first_only`` in rounds over the stored texts of one company and title, until one is found."""
        differ = np.array([texts[i] != self.texts[k] for i, k in zip(x.tolist(), j.tolist())], bool)
        x, j = x[differ], j[differ]
        if not self.first_only:
            rounds = [np.arange(len(x))]
        else:
            form = np.where(self.forms[j] < 0, -1 - j, self.forms[j])
            order = np.lexsort((j, form, x))
            x, j, form = x[order], j[order], form[order]
            begins = np.append(True, (x[1:] != x[:-1]) | (form[1:] != form[:-1]))
            group = np.cumsum(begins) - 1
            turn = np.log2(np.arange(len(x)) - np.flatnonzero(begins)[group] + 1).astype(np.int64)
            rounds = [np.flatnonzero(turn == r) for r in range(int(turn.max(initial=-1)) + 1)]
            done = np.zeros(len(begins), bool)
        for some in rounds:
            if self.first_only:
                some = some[~done[group[some]]]
            # One more than the exact bound, so that rounding never rejects a match.
            edits = self.edits(lengths[x[some]], self.lengths[j[some]]) + 1
            lcs = lcs_many(texts, self.texts, x[some], j[some], edits)
            some, lcs = some[lcs >= 0], lcs[lcs >= 0]
            if self.first_only:
                total = lengths[x[some]] + self.lengths[j[some]]
                hit = (100 * (1 - (total - 2 * lcs) / total) >= self.threshold) & (2 * lcs < total)
                done[group[some[hit]]] = True
            yield x[some], j[some], lcs

    def _search_short(self, texts: list[str], lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        letters = len(self.letters)
        near = np.flatnonzero((lengths > 0) & (lengths <= SHORT / (1 - self.loss) * (1 + self.loss) + 1))
        for size in np.unique(lengths[near]).tolist():
            same = near[lengths[near] == size]
            for part in np.split(same, range(SLICE, len(same), SLICE)):
                read = codes_of([texts[i] for i in part])[0].reshape(len(part), size)
                at = np.minimum(np.searchsorted(self.letters, read), letters - 1)
                at = np.where(self.letters[at] == read, at, letters)  # no stored text has it
                for tree in self.trees:
                    edits = int(self.edits(np.int64(size), np.int64(tree.size)))
                    if abs(size - tree.size) <= edits:
                        for x, j, lcs in tree.search(at, size, edits, letters):
                            yield part[x], j, lcs


class Index:
    """Pieces of stored texts, in order of their letters' hash and their place in the text."""

    def __init__(self, p: int, key: np.ndarray, text: np.ndarray, lengths: np.ndarray, loss: float) -> None:
        self.p, self.key, self.text, self.loss = p, key, text, loss
        self.shortest, self.longest = int(lengths.min()), int(lengths.max())
        # A bit for every piece and stretch of the text, so that most grams that no text has need not be looked up.
        widest = int(self.longest * 2 * loss / (1 - loss) ** 2 * 2) + 2
        self.stretch = np.uint64(max(4, widest.bit_length()))
        self.size = np.uint64(64 - max(16, (16 * len(key)).bit_length()))
        self.bits = np.zeros(1 << (64 - int(self.size) - 3), np.uint8)
        for low in range(0, len(key), AT_ONCE):
            some = key[low : low + AT_ONCE]
            self._mark(self._spot(some & ~_PLACE, (some & _PLACE) >> self.stretch))

    def _spot(self, h: np.ndarray, stretch: np.ndarray) -> np.ndarray:
        return _mixed(h + stretch * _ODD[1]) >> self.size

    def _mark(self, spot: np.ndarray) -> None:
        for bit in range(8):
            self.bits[(spot[spot & np.uint64(7) == bit] >> np.uint64(3)).astype(np.int64)] |= np.uint8(1 << bit)

    def _marked(self, spot: np.ndarray) -> np.ndarray:
        return self.bits.take((spot >> np.uint64(3)).astype(np.int64), mode="clip") >> (spot & np.uint64(7)).astype(np.uint8) & 1 == 1

    def coincidences(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, entry, place) of the grams of new texts that are pieces, at places that may fit; about AT_ONCE at a time."""
        # The lengths of stored texts that a match may have, and by how much places may differ then.
        ratio = (1 + self.loss) / (1 - self.loss)
        least, most = np.maximum(self.shortest, np.floor(lengths / ratio)), np.minimum(self.longest, np.ceil(lengths * ratio))
        back = np.ceil((self.loss * (lengths + least) - least + lengths) / 2).astype(np.int64) + 1
        ahead = np.ceil((self.loss * (lengths + most) + most - lengths) / 2).astype(np.int64) + 1
        fits = np.flatnonzero((least <= most) & (lengths >= self.p))
        if not fits.size:
            return
        h = _hashes(codes, self.p) & ~_PLACE
        owner, place = _spread(np.where(np.isin(np.arange(len(lengths)), fits), lengths - self.p + 1, 0))
        h = h[starts[owner] + place]
        low = np.minimum(np.maximum(place - back[owner], 0), int(_PLACE)).astype(np.uint64)
        high = np.minimum(np.maximum(place + ahead[owner], 0), int(_PLACE)).astype(np.uint64)
        near = self._marked(self._spot(h, low >> self.stretch))
        far = np.flatnonzero(~near & (high >> self.stretch != low >> self.stretch))
        near[far] = self._marked(self._spot(h[far], high[far] >> self.stretch))
        at = np.flatnonzero(near)
        at = at[np.argsort(h[at])]
        begin, end = np.searchsorted(self.key, h[at] | low[at]), np.searchsorted(self.key, h[at] | high[at], "right")
        hit = end > begin
        at, begin, n = at[hit], begin[hit], (end - begin)[hit]
        for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(n) // AT_ONCE)) + 1):
            if some.size:
                row, nth = _spread(n[some])
                yield owner[at[some]][row], begin[some][row] + nth, place[at[some]][row]


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def _counted(values: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct value, place of each value among them, number) of numbers that are less than ``below``."""
    if below > 8 * len(values) + AT_ONCE:
        return np.unique(values, return_inverse=True, return_counts=True)
    counts = np.bincount(values, minlength=1)
    distinct = np.flatnonzero(counts)
    at = np.empty(len(counts), np.int64)
    at[distinct] = np.arange(len(distinct))
    return distinct, at[values], counts[distinct]


def plan_cells(new: list[tuple[int, int, int]], stored: list[tuple[int, int, int]], reach: int, cores: int) -> list[tuple[int, int, int]]:
    """Cells as (lowest bucket, highest bucket, parts) of new texts, from (bucket, texts, characters) of both sides.

    A cell has neighbouring buckets with stored texts in ``reach``; one that is too large alone is dealt into parts.
    """
    cost = lambda row: row[2] + COST * row[1]
    met = sorted(b for b, _, _ in stored)
    near = lambda b: (k := bisect_left(met, b - reach)) < len(met) and met[k] <= b + reach
    rows = [row for row in sorted(new) if near(row[0])]
    most = min(CHUNK, max(CHUNK >> 6, sum(map(cost, rows)) // (2 * cores)))
    cells: list[list[int]] = []  # low, high, parts, cost
    for row in rows:
        c = cost(row)
        if c > most:
            cells.append([row[0], row[0], -(-c // most), most])
        elif cells and cells[-1][2] == 1 and cells[-1][3] + c <= most:
            cells[-1][1], cells[-1][3] = row[0], cells[-1][3] + c
        else:
            cells.append([row[0], row[0], 1, c])
    return [(low, high, parts) for low, high, parts, _ in cells]


def similar_in_cells(new: DataFrame, stored: DataFrame, threshold: float, tiers: list[tuple[int, int]], first_only: bool) -> DataFrame:
    """(nid, sid, description_score) of different texts; both sides have an id, ``_digest``, ``_text``, ``_len`` and ``_form``."""
    spark = new.sparkSession
    small_batches(new)
    bucket = F.floor(F.ln(F.col("_len")) * FINE).cast("int")
    measure = lambda df: [tuple(r) for r in df.where("_len > 0").groupBy(bucket.alias("b")).agg(F.count("*"), F.sum("_len")).collect()]
    # A number for each length that there is: at most FINE for each factor e.
    ours, theirs = measure(new), measure(stored)
    reach = math.ceil(FINE * math.log((200 - threshold) / threshold) + 1e-6) + 1
    # Bucket by bucket, the cell with its new texts and the cells in reach of its stored ones.
    own, met, cells = [], [], 0
    for low, high, parts in plan_cells(ours, theirs, reach, spark.sparkContext.defaultParallelism):
        own += [(b, parts, cells) for b, _, _ in ours if low <= b <= high]
        met += [(b, parts, cells) for b, _, _ in theirs if low - reach <= b <= high + reach]
        cells += parts
    output = "nid bigint, sid bigint, description_score double"
    if not cells:
        return spark.createDataFrame([], output)
    # Small tables whatever the number of texts, but Spark cannot tell that of rows from Python.
    plan = lambda rows: F.broadcast(spark.createDataFrame(rows, "b int, parts int, cell int"))
    with_bucket = lambda df: df.where("_len > 0").withColumn("b", bucket)
    # Copies of a text go to the same cells, where one of them stands for all.
    part = F.pmod(F.xxhash64("_digest"), F.col("parts")).cast("int")
    left = with_bucket(new).join(plan(own), "b").withColumn("cell", F.col("cell") + part).withColumn("_form", F.lit(None).cast("string"))
    right = with_bucket(stored).join(plan(met), "b").withColumn("cell", F.explode(F.sequence("cell", F.col("cell") + F.col("parts") - 1)))
    shape = lambda df, side, id_: df.select(
        "cell", F.lit(side).alias("side"), "b", "_digest", F.col(id_).alias("id"), F.col("_form").alias("form"), F.col("_text").alias("text")
    )
    both = shape(left, 0, "nid").unionByName(shape(right, 1, "sid"))
    dealt = both.repartitionById(cells, F.col("cell")).sortWithinPartitions("cell", "side", "b", "_digest", "id")
    return dealt.drop("b").mapInArrow(_searcher(threshold, tiers, first_only, CHUNK), output).dropDuplicates(["nid", "sid"])


def _searcher(
    threshold: float, tiers: list[tuple[int, int]], first_only: bool, most: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows of (cell, side, digest, id, form, text) in that order: hold the new texts of a cell, search them in a chunk of stored ones after the other."""

    def search(held: list[list], stored: list[list]) -> Iterator[pa.RecordBatch]:
        if not held or not stored:
            return
        chunk = Chunk([r[1] for r in stored], [r[2] for r in stored], [r[3] for r in stored], threshold, tiers, first_only)
        stored.clear()
        for found in chunk.search([r[1] for r in held], [r[3] for r in held]):
            for low in range(0, len(found[0]), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[low : low + 10_000]) for c in found], ["nid", "sid", "description_score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, stored, size = None, [], [], 0
        for batch in batches:
            cell, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(side) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(cell)]):
                if low == high:
                    continue
                if cell[low] != now:
                    yield from search(held, stored)
                    now, held, stored, size = cell[low], [], [], 0
                rows = zip(*(batch.column(i).slice(low, high - low).to_pylist() for i in (2, 3, 4, 5)))
                if side[low] == 0:
                    _add(held, rows)
                    continue
                for row in rows if held else ():
                    _add(stored, [row])
                    size += len(row[3]) + COST
                    # The last text may have copies that come next.
                    if size > most and len(stored) > 1:
                        last = stored.pop()
                        yield from search(held, stored)
                        stored, size = [last], len(last[3]) + COST
        yield from search(held, stored)

    return run


def _add(rows: list[list], more: Iterable[tuple]) -> None:
    """Append (digest, id, form, text) in order of digest and id; a copy only tells whether the form differs."""
    for row in more:
        if rows and rows[-1][0] == row[0]:
            if rows[-1][2] != row[2]:
                rows[-1][2] = None
        else:
            rows.append(list(row))
