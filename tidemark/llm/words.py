"""Vectorised word tokens, word hashes and n-gram hashes over Arrow string batches.

A word is a run of ASCII letters, digits or non-ASCII characters, ASCII upper
case folded to lower case.  Everything works on UTF-8 bytes straight from the
Arrow buffers, in slices of about ``SLICE_BYTES`` so that memory stays bounded
by the slice (or by the longest single text, if that is larger).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

# Byte -> folded byte for word bytes, 0 for separators.
FOLD = np.zeros(256, dtype=np.uint8)
for _b in range(256):
    if 0x41 <= _b <= 0x5A:
        FOLD[_b] = _b + 32
    elif 0x30 <= _b <= 0x39 or 0x61 <= _b <= 0x7A or _b >= 0x80:
        FOLD[_b] = _b

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    table = _powers.get(name)
    if table is None or len(table) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            table = np.full(size, np.uint64(base), dtype=np.uint64)
            table[0] = 1
            table = np.multiply.accumulate(table)
        if size <= 4 * SLICE_BYTES:
            _powers[name] = table
    return table[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word (wrapping uint64)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Words:
    """Words of a slice of texts.

    ``start``/``end`` are byte positions in ``folded``; ``hash`` the 64-bit word
    hashes; words of text ``i`` are ``first[i]:first[i + 1]``; ``text_start`` are
    the byte positions of the texts.
    """

    __slots__ = ("folded", "start", "end", "hash", "first", "text_start")

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        folded = FOLD[data]
        n = len(folded)
        inside = folded != 0
        edge = np.zeros(n + 1, dtype=bool)
        edge[bounds[(bounds >= 0) & (bounds <= n)]] = True
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(folded.astype(np.uint64) * _power_table("up", _BASE, n), out=sums[1:])
            raw = (sums[self.end] - sums[self.start]) * _power_table("down", _BASE_INV, n + 1)[self.start]
        self.hash = mix64(raw + (self.end - self.start).astype(np.uint64))
        self.folded = folded
        self.text_start = bounds
        self.first = np.searchsorted(self.start, bounds)

    def text_of_word(self) -> np.ndarray:
        counts = np.diff(self.first)
        return np.repeat(np.arange(len(counts)), counts)

    def word(self, i: int) -> bytes:
        return self.folded[self.start[i] : self.end[i]].tobytes()


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (the last n-1 positions have none)."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    m = len(h) - n + 1
    with np.errstate(over="ignore"):
        acc = h[:m] * np.uint64(0xD6E8FEB86659FD93)
        mult = 0xD6E8FEB86659FD93
        for j in range(1, n):
            mult = (mult * 0xA24BAED4963EE407 + 2) & ((1 << 64) - 1) | 1
            acc += h[j : j + m] * np.uint64(mult)
    return mix64(acc)


def inside_text(text_of_word: np.ndarray, n: int) -> np.ndarray:
    """Which positions of :func:`ngram_hashes` do not cross from one text into the next."""
    m = len(text_of_word) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=bool)
    return text_of_word[:m] == text_of_word[n - 1 :]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes (one text at least)."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row + 1, words) for consecutive slices of a text column."""
    raw, off = buffers(column)
    for i, j in slices(off, limit):
        yield i, j, Words(raw[off[i] : off[j]], off[i : j + 1] - off[i])


def find_sorted(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices into values, indices into table) of the values that the sorted table holds."""
    if not len(table) or not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    hit = np.flatnonzero(table[at] == values)
    return hit, at[hit]
