"""Words and hashes of many texts at once, on the bytes of Arrow string columns (numpy).

A column is handled in pieces of about `PIECE` bytes, so memory does not depend on the size of
a batch; a single text longer than that is one piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Word bytes of `[^\x20\x09-\x0D]+`.
NOT_SPACE = ~SPACE
#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are in lower case: digits, a-z, all of UTF-8 above ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15
_CODES = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of the base (or of its inverse) modulo 2**64."""
    powers = np.full(n, _BASE if kind == "up" else pow(_BASE, -1, 2**64), np.uint64)
    powers[:1] = 1
    return np.cumprod(powers, out=powers)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class RangeHash:
    """64-bit hashes of byte ranges of one buffer; equal ranges have equal hashes in any buffer."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODES[data] * _power("up", len(data)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        down = _power("down", len(self.sums))
        return mix((self.sums[end] - self.sums[start]) * down[start] + (end - start).astype(np.uint64))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the `len + 1` offsets of its texts; null is empty."""
    column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def pieces(column: pa.Array, limit: int = PIECE, rows: int = 2048) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """`(first, last, bytes, offsets)` for runs of texts of up to about `limit` bytes."""
    data, offsets = column_bytes(column)
    i, n = 0, len(column)
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), i + rows, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


@dataclass
class Words:
    """Words of some texts in one buffer, each followed by one space."""

    data: np.ndarray
    start: np.ndarray  # of each word in `data`
    end: np.ndarray
    first: np.ndarray  # index of the first word of each text, and the number of words at last
    origin: np.ndarray  # start of each word in the bytes that came in

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def grams(self, n: int, hashes: RangeHash | None = None, shorter: bool = True):
        """Hashes of the n-word windows, text by text, and the offsets of the texts in them.

        With `shorter`, a text of fewer words (but not none) has one window, all its words.
        """
        hashes = hashes or RangeHash(self.data)
        counts = self.counts()
        windows = np.maximum(counts - n + 1, np.minimum(counts, 1) if shorter else 0)
        offsets = np.concatenate(([0], np.cumsum(windows)))
        begin = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - self.first[:-1], windows)
        last = np.minimum(begin + n, np.repeat(self.first[1:], windows)) - 1
        if not len(begin):
            return np.zeros(0, np.uint64), offsets
        return hashes.of(self.start[begin], self.end[last]), offsets


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE, lower: bool = True) -> Words:
    """Lower-case A-Z, if `lower`, and take the maximal runs of bytes of `kind`; none spans two texts."""
    data = LOWER[data] if lower else data
    n = len(data)
    inside = kind[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if n else inside
    after = np.concatenate((inside[1:], [False])) if n else inside
    origin = np.flatnonzero(inside & (~before | edge[:n]))
    stop = np.flatnonzero(inside & (~after | edge[1:])) + 1
    length = stop - origin
    end = np.cumsum(length + 1) - 1
    start = end - length
    out = np.full(int(end[-1]) + 1 if len(end) else 0, 32, np.uint8)
    out[np.flatnonzero(inside) + np.repeat(start - origin, length)] = data[inside]
    return Words(out, start, end, np.searchsorted(origin, offsets), origin)


def apart(columns: list[str], prefix: str = "_") -> str:
    """A prefix for columns of one's own that no column of the input starts with."""
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix
