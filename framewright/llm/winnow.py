"""Winnowing fingerprints, seed chains and word alignment (problems 4 and 8)."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def words(text: str | None) -> list[str]:
    """Lower-case words; punctuation, case and spacing do not count."""
    return _WORD.findall(text.lower()) if text else []


def word_hash(w: str) -> int:
    """A 64-bit hash that is the same in every process."""
    h = 0xCBF29CE484222325
    for c in w.encode("utf-8", "replace"):
        h = ((h ^ c) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


class Hasher(dict):
    """Word -> hash, remembered up to a bounded number of words."""

    LIMIT = 1 << 20

    def __missing__(self, w: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[w] = word_hash(w)
        return h


def kgram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of all runs of ``k`` words (fewer words: empty)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _MULT + h[i : i + n]
    out ^= out >> np.uint64(29)
    out *= _MIX
    return out ^ (out >> np.uint64(32))


def window_minima(g: np.ndarray, w: int) -> np.ndarray:
    """True where a hash is the minimum of some window of ``w``; shorter inputs keep their minimum.

    Two texts that share ``k + w - 1`` words in a row share a kept hash.
    """
    n = len(g)
    keep = np.zeros(n, bool)
    if n == 0:
        return keep
    if n <= w:
        keep[g == g.min()] = True
        return keep
    low = g[: n - w + 1].copy()
    for i in range(1, w):
        np.minimum(low, g[i : n - w + 1 + i], out=low)
    for i in range(w):
        keep[i : n - w + 1 + i] |= g[i : n - w + 1 + i] == low
    return keep


def best_local(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int, int]:
    """Best local alignment of two word-hash sequences: match 1, mismatch and gap -1.

    Returns score and the aligned half-open ranges ``a0, a1, b0, b1``.
    """

    def table(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
        step = np.arange(len(y) + 1)
        row = np.zeros(len(y) + 1, np.int64)
        best = (0, 0, 0)
        for i, c in enumerate(x):
            new = np.zeros_like(row)
            np.maximum(row[:-1] + np.where(y == c, 1, -1), row[1:] - 1, out=new[1:])
            np.maximum(new, 0, out=new)
            new = np.maximum.accumulate(new + step) - step
            row = new
            m = int(row.max())
            if m > best[0]:
                best = (m, i + 1, int(row.argmax()))
        return best

    score, a1, b1 = table(a, b)
    if score == 0:
        return 0, 0, 0, 0, 0
    _, ra, rb = table(a[:a1][::-1], b[:b1][::-1])
    return score, a1 - ra, a1, b1 - rb, b1


def chains(i: Sequence[int], j: Sequence[int], drift: int = 8, gap: int = 30) -> list[tuple[int, int, int, int, int]]:
    """Collinear seed chains ``i0, i1, j0, j1, seeds`` from positions in two texts.

    Seeds belong together while their diagonals differ by at most ``drift`` and
    the next lies at most ``gap`` further on.
    """
    out = []
    order = sorted(range(len(i)), key=lambda s: (i[s], j[s]))
    open_: list[list[int]] = []  # i0, i1, j0, j1, n
    for s in order:
        x, y = i[s], j[s]
        for c in open_:
            if abs((x - y) - (c[1] - c[3])) <= drift and c[3] <= y <= c[3] + gap:
                c[1], c[3], c[4] = x, y, c[4] + 1
                break
        else:
            open_.append([x, x, y, y, 1])
        if len(open_) > 64:  # chains out of reach are done
            out += [tuple(c) for c in open_ if c[1] < x - gap]
            open_ = [c for c in open_ if c[1] >= x - gap]
    return out + [tuple(c) for c in open_]
