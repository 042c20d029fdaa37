"""Longest common subsequences of many pairs of texts at a time.

The bits of a row are the characters of one text, and a step reads a character of the other (Hyyro 2004). All pairs of a
batch step together. Two texts with d edits between them have a path that strays at most about d / 2 characters
from the diagonal, so a step has to do with the 64-bit words of that band only. The band is narrow at first, since most texts that
match have far fewer edits than they may; pairs with more edits than it allows for get a band eight times as wide.
"""

from __future__ import annotations

import numpy as np

from siftline.functions.similarity import _shared_head as shared_head

# Edits that the first band allows for; in a batch, words of a step, words of the tables and characters that are read.
NARROW, STEP, TABLE, READ = 48, 1 << 13, 1 << 21, 1 << 21
# Pairs from which a batch is worth its steps.
FEW = 96
_ALL = ~np.uint64(0)


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each text starts (and the last one ends)."""
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def lcs_many(ours: list[str], theirs: list[str], x: np.ndarray, y: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each ``ours[x]`` and ``theirs[y]``, or -1 if they are more than ``edits`` apart."""
    a = np.array([len(ours[i]) for i in x.tolist()], np.int64)
    b = np.array([len(theirs[i]) for i in y.tolist()], np.int64)
    out = np.full(len(x), -1, np.int64)
    open_ = np.flatnonzero(np.abs(a - b) <= edits)
    band = NARROW
    while open_.size:
        most = np.minimum(edits[open_], band)
        now = open_[np.abs(a - b)[open_] <= most]
        now = now[np.argsort(b[now], kind="stable")]
        begin = 0
        while begin < len(now):
            words = min(band, int(edits[now[begin]])) // 64 + 2
            size = int(max(FEW, min(STEP // words, READ // max(1, b[now[begin]]))))
            # Texts of a batch have like lengths, as all go as many steps as the longest.
            size = min(size, max(FEW, int(np.searchsorted(b[now], b[now[begin]] * 1.1 + 64, "right")) - begin))
            part = now[begin : begin + size]
            begin += size
            if len(part) >= FEW:
                _batch(ours, theirs, x, y, part, np.minimum(edits, band), a, b, out)
                continue
            for i in part.tolist():
                out[i] = lcs_within(ours[x[i]], theirs[y[i]], int(min(edits[i], band)))
        open_ = open_[(out[open_] < 0) & (edits[open_] > band)]
        band *= 8
    return out


def lcs_within(a: str, b: str, most: int) -> int:
    """Length of the longest common subsequence of two texts, or -1 if they are more than ``most`` edits apart."""
    head = shared_head(a, b)
    a, b = a[head:], b[head:]
    tail = shared_head(a[::-1], b[::-1])
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return -1
    low, high, step = -((most - n + m) // 2), (most + n - m) // 2, max(128, most)
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    base = width = lcs = row = 0
    for begin in range(0, m, step):
        # The characters of a that the next ones of b can meet.
        done = min(m, begin + step)
        behind = max(0, begin + low) - base
        lcs += behind - (row & ((1 << behind) - 1)).bit_count()
        row, base, width = row >> behind, base + behind, width - behind
        more = min(n, done + high) - base - width
        row |= ((1 << more) - 1) << width
        width += more
        full = (1 << width) - 1
        near = {ch: bits >> base & full for ch, bits in where.items()}
        for ch in b[begin:done]:
            hit = row & near.get(ch, 0)
            row = (row + hit | row ^ hit) & full
        end = max(0, done + n - m)
        if end + done - 2 * (lcs + end - base - (row & ((1 << end - base) - 1)).bit_count() if end > base else lcs) > most:
            return -1
    lcs += width - row.bit_count()
    return lcs + head + tail if n + m - 2 * lcs <= most else -1


def _batch(ours: list[str], theirs: list[str], x: np.ndarray, y: np.ndarray, part: np.ndarray, most: np.ndarray, a: np.ndarray, b: np.ndarray, out: np.ndarray) -> None:
    """Fill in ``out`` for the pairs ``part`` that are at most ``most`` edits apart."""
    mine, at = np.unique(x[part], return_inverse=True)
    codes, starts = codes_of([ours[i] for i in mine.tolist()])
    rank = np.zeros(0x110000, np.int32)
    rank[codes] = 1
    letters = int(rank.sum())
    words = int(a[part].max()) // 64 + 1
    width = len(mine) * words
    if (letters + 1) * width > TABLE and len(part) >= 2 * FEW:
        half = len(part) // 2
        by_text = part[np.argsort(x[part], kind="stable")]
        _batch(ours, theirs, x, y, by_text[:half], most, a, b, out)
        _batch(ours, theirs, x, y, by_text[half:], most, a, b, out)
        return
    rank = np.where(rank > 0, np.cumsum(rank, dtype=np.int32) - 1, letters)
    # Row by row for a letter, the places of it in our texts; the last row is for letters that none of them has.
    grid = np.full((len(mine), words * 64), letters, np.int32)
    grid[_places(starts)] = rank[codes]
    grid = grid.reshape(width, 64)
    table = np.zeros((letters + 1, width), np.uint64)
    column = np.arange(width)
    for bit in range(64):
        table[grid[:, bit], column] |= np.uint64(1 << bit)
    table[letters] = 0
    table = table.ravel()
    yours, other = np.unique(y[part], return_inverse=True)
    codes, starts = codes_of([theirs[i] for i in yours.tolist()])
    grid = np.full((len(yours), int(b[part].max())), letters, np.uint16 if letters < 1 << 16 else np.int32)
    grid[_places(starts)] = rank[codes]
    read = np.ascontiguousarray(grid.T).take(other, axis=1)
    del grid, codes, rank
    _steps(table, words, width, read, at * words, part, most[part], a[part], b[part], out)


def _places(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in it) of all characters."""
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return text, np.arange(len(text)) - starts[text]


def _steps(table: np.ndarray, words: int, width: int, read: np.ndarray, at: np.ndarray, part: np.ndarray, most: np.ndarray, a: np.ndarray, b: np.ndarray, out: np.ndarray) -> None:
    row = np.full((words, len(part)), _ALL)
    low, high = int((-((most - a + b) // 2)).min()), int(((most + a - b) // 2).max())
    number = np.arange(words)[:, None]
    t0 = 0
    for t in range(len(read)):
        first, last = max(0, (t + low) >> 6), min(words, ((t + high) >> 6) + 1)
        if first >= last:
            continue
        old = row[first:last]
        hit = table.take(read[t - t0] * np.int64(width) + at + number[first:last], mode="clip")
        hit &= old
        new = old + hit
        if last - first > 1:
            carry = new < old
            if last - first <= 4:
                for w in range(1, last - first):
                    new[w] += carry[w - 1]
                    carry[w] |= carry[w - 1] & (new[w] == 0)
            else:
                up, above = carry[:-1], new[1:]
                while up.any():
                    above += up
                    carry[1:] = up & (above == 0)
                    carry[0] = False
                    up = carry[:-1].copy()
        np.bitwise_xor(old, hit, out=old)
        np.bitwise_or(old, new, out=old)
        done = t + 1
        if done % 64 == 0 and done < len(read):
            # A text on the way to its end has had no more edits on this diagonal than it has in all.
            end = np.minimum(done + a - b, a)
            bits = np.bitwise_count(~row)
            whole = end >> 6
            lcs = np.where(number < whole, bits, 0).sum(axis=0, dtype=np.int64)
            rest = np.minimum(np.maximum(whole, 0), words - 1)
            mask = (np.uint64(1) << (np.maximum(end, 0) & 63).astype(np.uint64)) - np.uint64(1)
            lcs += np.bitwise_count(~row[rest, np.arange(len(part))] & mask)
            dead = (done < b) & (end >= 0) & (end + done - 2 * lcs > most)
            if dead.sum() * 4 > len(part):
                keep = ~dead
                if not keep.any():
                    return
                row, read, t0 = np.ascontiguousarray(row[:, keep]), read[done - t0 :, keep], done
                part, at, most, a, b = part[keep], at[keep], most[keep], a[keep], b[keep]
                low, high = int((-((most - a + b) // 2)).min()), int(((most + a - b) // 2).max())
    lcs = np.bitwise_count(~row).sum(axis=0, dtype=np.int64)
    ok = a + b - 2 * lcs <= most
    out[part[ok]] = lcs[ok]
