"""Words of whole texts as 64-bit hashes, computed on Arrow buffers.

A word is a run of bytes that are no ASCII white space (0x20, 0x09-0x0D), with A-Z
in lower case.  Equal words have equal hashes; different ones collide with a
probability of about 2**-64 a pair.  Null and empty texts have no words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
STEP = 0xD1342543DE82EF95
CHUNK = 1 << 20  # bytes of text hashed at once: bounds the working arrays


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser: every bit of the result depends on every bit of ``h``."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hasher:
    """Polynomial hashes of all words of a buffer; keeps the powers it needs."""

    def __init__(self) -> None:
        table = np.arange(256, dtype=np.uint8)
        table[65:91] += 32
        self.lower = table.astype(np.uint64) + np.uint64(1)
        self.is_word = np.ones(256, dtype=bool)
        self.is_word[[9, 10, 11, 12, 13, 32]] = False
        self.grow(CHUNK)

    def grow(self, n: int) -> None:
        base, inverse = np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))
        self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base))])
        self.inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, inverse))])

    def __call__(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, first and end byte of the words of ``data``; texts begin at ``cuts``."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n >= len(self.power):
            self.grow(2 * n)
        inside = self.is_word[data]
        new_text = np.zeros(n + 1, bool)
        new_text[cuts] = True
        before = np.concatenate([[False], inside[:-1]]) & ~new_text[:-1]
        after = np.concatenate([inside[1:], [False]]) & ~new_text[1:]
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        total = np.concatenate([[np.uint64(0)], np.cumsum(self.lower[data] * self.power[:n])])
        return mixed((total[ends] - total[starts]) * self.inverse[starts]), starts, ends


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and text limits of an Arrow string column; a null is an empty text."""
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    limits = np.frombuffer(offsets, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), limits


def word_chunks(col: pa.Array, hasher: Hasher | None = None) -> Iterator[tuple]:
    """(first text, end text, hashes, word limits of each text, first bytes, end
    bytes, data) for runs of texts of about ``CHUNK`` bytes; a text is never cut."""
    hasher = hasher or Hasher()
    data, limits = text_buffers(col)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(limits, limits[lo] + CHUNK, side="right")) - 1)
        part = data[limits[lo] : limits[hi]]
        local = limits[lo : hi + 1] - limits[lo]
        h, starts, ends = hasher(part, local)
        yield lo, hi, h, np.searchsorted(starts, local), starts, ends, part
        lo = hi


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on (``len(h) - k + 1`` of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc = acc * np.uint64(STEP) + h[j : j + n]
    return mixed(acc ^ np.uint64(k))


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles of one text; fewer than ``k`` words are one shingle."""
    if len(h) == 0:
        return np.zeros(0, np.uint64)
    return np.unique(shingles(h, min(k, len(h))))
