"""Passages that repeat across documents, by a distributed merge sort of suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftline.llm.common import id_in, id_out, parts_for, small_batches, text_in, total_bytes

CHUNK_BYTES = 8 << 20
BLOCK_BYTES = 1 << 17
HOT_ANCHOR = 1 << 16
BLOBS = "chunk int, part int, kind int, rows binary, more binary"
_TABLE = np.random.default_rng(9).integers(0, 2**64, 256, np.uint64) | np.uint64(1)


@dataclass(frozen=True)
class Windows:
    """Strings of ``length`` bytes; each is filed under the least ``gram``-byte string inside it."""

    length: int = 50

    @property
    def gram(self) -> int:
        return max(1, min(20, self.length), self.length - 60)

    @property
    def reach(self) -> int:
        return self.length - self.gram + 1


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hash of the ``gram`` bytes from every place, by doubling the length."""
    out, done, power = None, 0, _TABLE[data]
    size, base = 1, 0x9E3779B97F4A7C15
    while True:
        if gram & size:
            if out is None:
                out, done = power, size
            else:
                m = len(power) - done
                out = out[:m] * np.uint64(pow(base, size, 2**64)) + power[done : done + m]
                done += size
        size *= 2
        if size > gram:
            break
        half = size // 2
        power = power[: len(power) - half] * np.uint64(pow(base, half, 2**64)) + power[half:]
    out = out[: max(0, len(data) - gram + 1)]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n, size = len(values) - width + 1, 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:n], values[width - size : width - size + n])


def anchors(data: np.ndarray, starts: np.ndarray, w: Windows) -> tuple[np.ndarray, ...]:
    """(document, anchor, first window, last window, hash) of every run of windows with one anchor.

    ``starts`` are the documents' offsets in ``data``, the end included. The anchor
    of a window is the leftmost gram with the least hash in it, so equal windows
    have equal anchors at equal distances wherever they stand.
    """
    found: list[tuple[np.ndarray, ...]] = []
    doc, n_docs = 0, len(starts) - 1
    while doc < n_docs:
        last = max(doc + 1, int(np.searchsorted(starts, starts[doc] + BLOCK_BYTES, "right")) - 1)
        lo, hi = int(starts[doc]), int(starts[last])
        for at in range(lo, max(lo + 1, hi - w.length + 1), 1 << 22):  # one slice, unless a document is very long
            end = min(hi, at + (1 << 22) + w.length - 1)
            if end - at < w.length:
                continue
            hashes = _gram_hashes(data[at:end], w.gram)
            ranked = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
            least = _sliding_min(ranked, w.reach) & np.uint64(0xFFFFFFFF)
            windows = np.arange(at, at + len(least))
            owner = np.searchsorted(starts, windows, "right") - 1
            inside = windows + w.length <= starts[owner + 1]
            windows, owner, least = windows[inside], owner[inside], least[inside].astype(np.int64)
            if len(windows):
                turn = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
                ends = np.r_[turn[1:] - 1, len(windows) - 1]
                chosen = hashes[least[turn]]
                # Least hashes begin with zeros, so the halves change places: parts are cut by the other half.
                chosen = chosen << np.uint64(32) | chosen >> np.uint64(32)
                found.append((owner[turn], at + least[turn], windows[turn], windows[ends], chosen))
        doc = last
    if not found:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found))


def _bytes_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a chunk as one run of bytes, and where each begins."""
    texts = table.column("text").cast(pa.large_string()).combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    values = texts.buffers()[2]
    data = np.frombuffer(values, np.uint8) if values else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _blobs(rows: list[tuple]) -> pa.Table:
    fields = [("chunk", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("rows", pa.binary()), ("more", pa.binary())]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _gram_lists(parts: int, w: Windows):
    """Per chunk: the sorted anchors it holds, by part, each marked if two documents of the chunk have it.

    Behind the marks: which anchors stand in several places, and in how many.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        data, starts = _bytes_of(table)
        ids = table.column("doc_id").to_numpy()
        doc, _, _, _, hashes = anchors(data, starts, w)
        if not len(hashes):
            return _blobs([])
        order = np.argsort(hashes, kind="stable")
        hashes, who = hashes[order], ids[doc[order]]
        first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        several = np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)
        hashes, places = hashes[first], np.diff(np.r_[first, len(hashes)])
        cuts = np.searchsorted(_part_of(hashes, parts), np.arange(parts + 1))
        return _blobs([
            (key[0].as_py(), p, 0, hashes[i:j].tobytes(), _marked(several[i:j], places[i:j]))
            for p, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i
        ])

    return run


def _marked(several: np.ndarray, places: np.ndarray) -> bytes:
    more = places > 1
    return np.packbits(several).tobytes() + np.packbits(more).tobytes() + places[more].astype(np.uint32).tobytes()


def _marks_of(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    flags = (n + 7) // 8
    several, more = (np.unpackbits(np.frombuffer(blob, np.uint8, flags, i * flags))[:n].astype(bool) for i in (0, 1))
    places = np.ones(n, np.int64)
    places[more] = np.frombuffer(blob, np.uint32, offset=2 * flags)
    return several, places


def _shared_grams(hot_anchor: int):
    """Per part: which anchors of each chunk stand in two documents or more, and which of them in more than ``hot_anchor`` places."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(r.as_py(), np.uint64) for r in table.column("rows")]
        several, places = map(np.concatenate, zip(*[_marks_of(m.as_py(), len(x)) for m, x in zip(table.column("more"), lists)]))
        hashes = np.concatenate(lists)
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        chunks = np.diff(np.r_[first, len(hashes)])
        shared, hot = np.empty(len(hashes), bool), np.empty(len(hashes), bool)
        shared[order] = np.repeat((chunks > 1) | np.logical_or.reduceat(several[order], first), chunks)
        hot[order] = np.repeat(np.add.reduceat(places[order], first) > hot_anchor, chunks)
        cuts = np.cumsum([0, *map(len, lists)])
        part = key[0].as_py()
        return _blobs([
            (chunk.as_py(), part, 1, x[shared[i:j]].tobytes(), np.packbits(hot[i:j][shared[i:j]]).tobytes())
            for chunk, x, i, j in zip(table.column("chunk"), lists, cuts[:-1], cuts[1:]) if shared[i:j].any()
        ])

    return run


@dataclass
class Suffixes:
    """The distinct suffixes of a chunk at shared anchors, in order, and the places they stand at.

    A row of ``text`` has the bytes from the anchor on, then those before it
    backwards, then both lengths; ``least`` is the smallest document with it. At
    a hot anchor a row is a single window, so that windows can go to different
    parts. ``row_of`` has the rows of the suffix in place ``of``, from ``begin`` on:
    one, or at a hot anchor (``step`` 1) one per window, the last window first.
    """

    text: np.ndarray
    least: np.ndarray
    part: np.ndarray
    doc: np.ndarray
    anchor: np.ndarray
    first: np.ndarray
    last: np.ndarray
    of: np.ndarray
    row_of: np.ndarray
    begin: np.ndarray
    step: np.ndarray


def _distinct(rows: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a place of each distinct row in their order, its smallest document, number of the distinct row in every place)."""
    n = len(rows)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    flat = np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    of = np.empty(n, np.int64)
    of[order] = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    return order[heads], np.minimum.reduceat(docs[order], heads), of


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        out = out * np.uint64(0x9E3779B97F4A7C15) + _TABLE[column]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _windows_of(rows: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Each window of the suffixes ``rows`` as a row of its own, the last window first; and how many each suffix has."""
    right, left = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
    least = w.length - right  # the distance of the last window's start to the anchor
    counts = left - least + 1
    which = np.repeat(np.arange(len(rows)), counts)
    back = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + least[which]
    out = rows[which]
    out[:, : w.length][np.arange(w.length)[None, :] >= (w.length - back)[:, None]] = 0
    out[:, w.length : -2][np.arange(w.reach - 1)[None, :] >= back[:, None]] = 0
    out[:, -2], out[:, -1] = w.length - back, back
    return out, counts


def _suffixes(data: np.ndarray, starts: np.ndarray, ids: np.ndarray, shared: pa.Table, parts: int, w: Windows) -> Suffixes:
    doc, anchor, first, last, hashes = anchors(data, starts, w)
    lists = [np.frombuffer(r, np.uint64) for r in shared.column("rows").to_pylist()]
    flags = [np.unpackbits(np.frombuffer(m, np.uint8))[: len(x)] for m, x in zip(shared.column("more").to_pylist(), lists)]
    known = np.concatenate(lists) if lists else np.empty(0, np.uint64)
    order = np.argsort(known, kind="stable")
    known, hot_known = known[order], (np.concatenate(flags)[order].astype(bool) if lists else np.empty(0, bool))
    at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
    keep = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
    doc, anchor, first, last, hashes, at = (x[keep] for x in (doc, anchor, first, last, hashes, at))
    n, right, left = len(doc), last + w.length - anchor, anchor - first
    rows = np.zeros((n, w.length + w.reach + 1), np.uint8)
    for i in range(w.length):
        rows[:, i] = np.where(i < right, data[np.minimum(anchor + i, len(data) - 1)], 0) if n else 0
    for i in range(w.reach - 1):
        rows[:, w.length + i] = np.where(i < left, data[np.maximum(anchor - 1 - i, 0)], 0) if n else 0
    rows[:, -2], rows[:, -1] = right, left
    heads, least, of = _distinct(rows, ids[doc])
    rows, part = rows[heads], _part_of(hashes[heads], parts)
    hot = hot_known[at[heads]] if len(known) else np.zeros(len(heads), bool)
    row_of, begin, step = np.arange(len(rows)), np.arange(len(rows)), hot.astype(np.int64)
    if hot.any():
        windows, counts = _windows_of(rows[hot], w)
        tops, top_least, number = _distinct(windows, np.repeat(least[hot], counts))
        windows = windows[tops]
        cold = np.flatnonzero(~hot)
        row_of, begin = np.r_[np.arange(len(cold)), len(cold) + number], np.empty(len(rows), np.int64)
        begin[cold], begin[hot] = np.arange(len(cold)), len(cold) + np.cumsum(counts) - counts
        part = np.r_[part[cold], _part_of(_row_hashes(windows), parts)]
        rows, least = np.concatenate([rows[cold], windows]), np.r_[least[cold], top_least]
        # Parts want their rows in order; those of hot anchors come in between.
        order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        rows, least, part, row_of = rows[order], least[order], part[order], place[row_of]
    return Suffixes(rows, least, part, doc, anchor, first, last, of, row_of, begin, step)


def _common(rows: np.ndarray, width: int) -> np.ndarray:
    """Length of the common prefix of every row with the row before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1 and width:
        differs = rows[1:, :width] != rows[:-1, :width]
        out[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    return out


def _front_code(rows: np.ndarray, w: Windows) -> bytes:
    """Sorted suffixes as (known prefix, rest) with what stands before the anchor."""
    known = _common(rows, w.length)
    rest = rows[:, : w.length][np.arange(w.length)[None, :] >= known[:, None]]
    return known.astype(np.uint8).tobytes() + rows[:, w.length :].tobytes() + rest.tobytes()


def _front_decode(blob: bytes, n: int, w: Windows) -> tuple[list[bytes], list[int], np.ndarray]:
    known = list(blob[:n])
    side = w.reach + 1
    rest = np.frombuffer(blob, np.uint8, n * side, n).reshape(n, side)
    at, before, out = n + n * side, b"", []
    for k in known:
        before = before[:k] + blob[at : at + w.length - k]
        at += w.length - k
        out.append(before)
    return out, known, rest


def merge_runs(runs: list[list[bytes]], known: list[list[int]], width: int) -> tuple[list[int], list[int]]:
    """Merge sorted runs of ``width``-byte strings: (run of each output, prefix it shares with the one before).

    A loser tree whose contenders carry the prefix they share with the last
    output: the longer prefix wins without a look at the strings, and equal
    prefixes are compared behind them only, so no byte is compared again that
    is known to be equal.
    """
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    heads = [r[0] if r else b"" for r in runs] + [b""] * (leaves - len(runs))
    have = [0 if r else -1 for r in runs] + [-1] * (leaves - len(runs))
    place = [0] * leaves
    loser = [0] * leaves

    def second(a: int, b: int, at: int) -> bool:
        """Whether ``a`` comes after ``b``; the later one then carries what both share."""
        x, y = heads[a], heads[b]
        if x[at:] == y[at:]:
            have[b] = width
            return False
        while x[at] == y[at]:
            at += 1
        if x[at] > y[at]:
            have[a] = at
            return True
        have[b] = at
        return False

    winner, level = list(range(leaves)), leaves
    while level > 1:
        level //= 2
        for i in range(level):
            a, b = winner[2 * i], winner[2 * i + 1]
            if have[a] < have[b] or have[a] == have[b] >= 0 and second(a, b, have[a]):
                a, b = b, a
            winner[i], loser[level + i] = a, b
    now, total = winner[0], sum(map(len, runs))
    order, shared = [], []
    for _ in range(total):
        order.append(now)
        shared.append(have[now])
        place[now] += 1
        if place[now] < len(runs[now]):
            heads[now], have[now] = runs[now][place[now]], known[now][place[now]]
        else:
            have[now] = -1
        node = (leaves + now) >> 1
        while node:
            other = loser[node]
            mine, theirs = have[now], have[other]
            if mine < theirs or mine == theirs >= 0 and second(now, other, mine):
                loser[node], now = now, other
            node >>= 1
    return order, shared


def _sort_runs(parts: int, w: Windows):
    """Per chunk: its sorted suffixes at shared anchors, front-coded, one run per part."""

    def run(key: tuple, docs: pa.Table, shared: pa.Table) -> pa.Table:
        if not docs.num_rows or not shared.num_rows:
            return _blobs([])
        data, starts = _bytes_of(docs)
        ids = docs.column("doc_id").to_numpy()
        s = _suffixes(data, starts, ids, shared, parts, w)
        order = np.argsort(s.part, kind="stable")
        cuts = np.searchsorted(s.part[order], np.arange(parts + 1))
        return _blobs([
            (key[0].as_py(), p, 2, _front_code(s.text[rows], w), s.least[rows].tobytes())
            for p in range(parts) if len(rows := order[cuts[p] : cuts[p + 1]])
        ])

    return run


def _merge(w: Windows):
    """Per part: merge the runs, and mark for each suffix the windows that a smaller document has."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        runs, known, sides, docs = [], [], [], []
        for rows, more in zip(table.column("rows"), table.column("more")):
            docs.append(np.frombuffer(more.as_py(), np.int64))
            run_, known_, side = _front_decode(rows.as_py(), len(docs[-1]), w)
            runs.append(run_)
            known.append(known_)
            sides.append(side)
        of_run, shared = merge_runs(runs, known, w.length)
        sizes = [len(x) for x in docs]
        order = np.argsort(np.argsort(np.asarray(of_run), kind="stable"), kind="stable")
        least, side = np.concatenate(docs)[order], np.concatenate(sides)[order]
        shared = np.asarray(shared)
        shared[0] = 0
        n, right, left = len(least), side[:, -2].astype(np.int64), side[:, -1].astype(np.int64)
        before = np.ascontiguousarray(side[:, :-2])
        by_left = np.lexsort((np.arange(n), before.view(f"S{before.shape[1]}").ravel())) if before.shape[1] else np.arange(n)
        left_shared = _common(before[by_left], before.shape[1])
        alone = np.maximum(shared, np.r_[shared[1:], 0]) < w.gram
        marks = np.zeros(n, np.uint64)
        for o in range(w.reach):
            mine = np.flatnonzero((left >= o) & (right >= w.length - o) & ~alone)
            if len(mine) < 2:
                continue
            block = np.cumsum(shared < w.length - o)[mine]
            side_block = np.empty(n, np.int64)
            side_block[by_left] = np.cumsum(left_shared < o) if o else 0
            cell = block * (n + 1) + side_block[mine]
            ranked = np.argsort(cell, kind="stable")
            first = np.flatnonzero(np.r_[True, cell[ranked][1:] != cell[ranked][:-1]])
            smallest = np.minimum.reduceat(least[mine[ranked]], first)
            seen = np.repeat(smallest, np.diff(np.r_[first, len(mine)])) < least[mine[ranked]]
            marks[mine[ranked[seen]]] |= np.uint64(1 << o)
        back = np.empty(n, np.uint64)
        back[order] = marks
        cuts = np.cumsum([0, *sizes])
        return _blobs([
            (chunk.as_py(), key[0].as_py(), 3, back[i:j].tobytes(), b"")
            for chunk, i, j in zip(table.column("chunk"), cuts[:-1], cuts[1:])
        ])

    return run


def _remove(parts: int, w: Windows, carry: list[str], as_text: bool):
    """Per chunk: the documents without the bytes of windows that a smaller document has."""

    def run(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        data, starts = _bytes_of(docs)
        ids = docs.column("doc_id").to_numpy()
        kinds = told.column("kind").to_numpy()
        shared = told.filter(pa.array(kinds == 1))
        marks = told.filter(pa.array(kinds == 3)).sort_by("part")
        gone = np.zeros(len(data), bool)
        if shared.num_rows and marks.num_rows:
            s = _suffixes(data, starts, ids, shared, parts, w)
            mask = np.empty(len(s.least), np.uint64)
            mask[np.argsort(s.part, kind="stable")] = np.concatenate(
                [np.frombuffer(m.as_py(), np.uint64) for m in marks.column("rows")]
            )
            edge = np.zeros(len(data) + 1, np.int8)
            repeated = np.zeros(len(data), bool)
            who, begin, step = ids[s.doc], s.begin[s.of], s.step[s.of]
            nearest = s.anchor - s.last
            for o in range(w.reach):
                has = np.flatnonzero((nearest <= o) & (s.anchor - o >= s.first))
                row = s.row_of[begin[has] + step[has] * (o - nearest[has])]
                # Another chunk or this one has a smaller document with the window.
                yes = (mask[row] >> np.uint64(o) & np.uint64(1)).astype(bool) | (who[has] > s.least[row])
                repeated[s.anchor[has[yes]] - o] = True
            begins = np.flatnonzero(repeated)
            if len(begins):
                run_start = np.r_[True, begins[1:] > begins[:-1] + w.length]
                opens = begins[run_start]
                closes = np.r_[begins[:-1][run_start[1:]], begins[-1]] + w.length
                edge[opens] += 1
                edge[closes] -= 1
                gone = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        out = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for i, doc in enumerate(ids):
            body, cut = data[starts[i] : starts[i + 1]], gone[starts[i] : starts[i + 1]]
            n = int(cut.sum())
            kept = body[~cut].tobytes() if n else body.tobytes()
            spans = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum()) if n else 0
            for name, value in zip(out, (doc, len(body), n, spans, kept)):
                out[name].append(value)
        hashes = [hashlib.sha256(k).hexdigest() for k in out["kept"]]
        if as_text:
            out["kept"] = [k.decode("utf-8", "ignore") for k in out["kept"]]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary())
        columns = {name: pa.array(v, t) for (name, v), t in zip(out.items(), types)}
        return pa.table(columns | {"kept_sha256": pa.array(hashes, pa.string())} | {c: docs.column(c) for c in carry})

    return run


def remove_repeats(
    docs: DataFrame, length: int = 50, carry: tuple[str, ...] = (), as_text: bool = False, chunk_bytes: int = CHUNK_BYTES,
    hot_anchor: int = HOT_ANCHOR,
) -> DataFrame:
    """``docs`` (doc_id, text) without the bytes covered by ``length``-byte strings of smaller documents.

    Returns doc_id, n_bytes, n_removed, n_spans, kept (the rest: bytes, or with
    ``as_text`` a string without characters that a cut has broken), kept_sha256 and
    the columns ``carry`` for every row of ``docs``. Texts are their UTF-8 bytes,
    a null text is empty, and strings neither cross documents nor count what was
    removed elsewhere. Rows with the same doc_id are one document to each other.
    A null id is the smallest and comes back as null. Other columns are not read;
    an empty table gives an empty one.

    How: documents are spread over chunks of about ``chunk_bytes`` by id and text. Every window
    of ``length`` bytes is filed under its anchor, the least-hashed gram inside
    it, so that equal windows have equal anchors. A first exchange of sorted
    anchor hashes tells each chunk which anchors another document has; others
    cannot begin a match. Then a merge sort of the suffixes at those anchors:
    each chunk sorts its suffixes (equal ones fall together, with the smallest
    document), sends them front-coded, one run per part, and each part merges
    its runs with a loser tree that starts every comparison behind the known
    common prefix. The common prefixes of neighbours in that order, with those of the
    bytes before the anchor, group equal windows, and the smallest document of
    a group keeps its bytes. An anchor in more than ``hot_anchor`` places, such as a
    phrase of a third of all documents, is split: each chunk sends its distinct
    windows there one by one, with the smallest document, and they go to parts by
    their own hash. What a task holds is a chunk, or the distinct
    suffixes that fall into a part, at most ``hot_anchor`` of one anchor and one per
    chunk of a window at a hot one; copies of a passage fall together in
    their chunks, whatever their number. A text longer than ``chunk_bytes`` makes its chunk longer.
    """
    small_batches(docs)
    w = Windows(length)
    named = docs.select(
        id_in("doc_id").alias("doc_id"), text_in().alias("text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)]
    )
    chunks = parts_for(total_bytes(named, "text"), chunk_bytes)
    # By id and text, so that the rows of one id, such as null, are spread; only equal rows of one id stay together.
    rows = named.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    kept = [f"_c{i}" for i in range(len(carry))]
    lists = rows.groupBy("chunk").applyInArrow(_gram_lists(chunks, w), BLOBS)
    shared = lists.groupBy("part").applyInArrow(_shared_grams(hot_anchor), BLOBS)
    runs = rows.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_sort_runs(chunks, w), BLOBS)
    marks = runs.groupBy("part").applyInArrow(_merge(w), BLOBS)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept {'string' if as_text else 'binary'}, kept_sha256 string"
    schema = ", ".join([schema, *[f"{c} {types[c]}" for c in kept]])
    told = shared.union(marks)
    cleaned = rows.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_remove(chunks, w, kept, as_text), schema)
    return cleaned.select(
        id_out("doc_id"), "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256",
        *[F.col(k).alias(c) for k, c in zip(kept, carry)],
    )
