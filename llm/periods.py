"""Periodic runs of words, found by internal pattern matching.

A run is a maximal stretch of words with smallest period q: words q apart are the same, no neighbouring word
extends it, and it has at least `least` words and two periods.

*Method.*  Names of dyadic blocks (words at i .. i + 2^k have a rank among all blocks of that length) give the
suffix array; blocks with equal names are an interval of it.  For periods from 2b - 1 to 4b - 2, every
aligned block of b words asks where it occurs next in the window that many words further on: a range
successor query on a wavelet tree over the suffix array.  A run of such a period holds an aligned block and its
copy one period later, so it is met.  Occurrences that follow each other by at most b / 2 form an
arithmetic progression, which is taken as a whole from one comparison.  Each distance is a candidate period; it
is extended to both sides by the names, and the smallest period of each stretch is kept.  Queries
of all blocks of a level are answered together (numpy).

*Screen.*  Each six-word window of a run occurs again in the same text.  Only stretches of words
covered by such windows go through the search, with a separator of its own after each, so most texts cost one
sort of window hashes.  Equal windows have equal hashes, so nothing is lost; words are compared by bytes.

Texts are independent, so nothing is shuffled.  Memory follows the longest text (the names of n words are
n log n numbers).  Null and empty texts have no words, no runs and an empty collapsed text.  Rows that repeat an id
or have none are texts of their own.  An empty table gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.crcmatrix import by_length, distinct_rows, matrix
from llm.textops import RangeHash, Words, mix, pieces, words

#: A run of at least 12 words and two periods has a copy of each six-word window.
LEAST, WINDOW = 12, 6


class Blocks:
    """Names of all dyadic blocks of a sequence, and its suffix array.

    `names[k][i]` is the rank of the 2^k symbols from i on; the last level has only different names.  The last
    symbol of the sequence must occur once.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        now = np.unique(symbols, return_inverse=True)[1].ravel().astype(np.int32) + 1
        self.names, width = [now], 1
        while now.max() < n:
            key = now.astype(np.int64) * (n + 1)
            key[:-width] += now[width:]
            order = np.argsort(key)
            ranked = key[order]
            now = np.empty(n, np.int32)
            now[order] = 1 + np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1])))
            self.names.append(now)
            width *= 2
        self.suffixes = np.empty(n, np.int32)
        self.suffixes[now - 1] = np.arange(n, dtype=np.int32)

    def interval(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the suffix array with the occurrences of the block of 2^k symbols at `at`."""
        ordered = self.names[k][self.suffixes]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
        name = self.names[k][at]
        return first[name - 1], first[name]

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and j on (i < j) are the same."""
        last, same = len(self.suffixes) - 1, np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 2, -1, -1):
            a, b = i + same, np.minimum(j + same, last)
            same += (self.names[k][a] == self.names[k][b]).astype(np.int64) << k
        return same

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols before i and j (i < j) are the same."""
        same = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 2, -1, -1):
            a, b = i - same - (1 << k), j - same - (1 << k)
            same += ((a >= 0) & (self.names[k][np.maximum(a, 0)] == self.names[k][np.maximum(b, 0)])).astype(np.int64) << k
        return same


class WaveletTree:
    """Range successor queries over a sequence of numbers below its length, all queries at once."""

    def __init__(self, values: np.ndarray):
        self.size = len(values)
        self.bits = max(self.size - 1, 1).bit_length()
        self.zeros = []  # for each bit, from the highest on: zeros before each place
        for bit in range(self.bits - 1, -1, -1):
            zero = (values >> bit) & 1 == 0
            before = np.zeros(self.size + 1, np.int32)
            np.cumsum(zero, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate((values[zero], values[~zero]))

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest number from `least` on in each `values[low:high]`, or the length if there is none."""
        l, r, below = low, high, np.zeros(len(low), np.int64)
        x = np.minimum(least, self.size - 1)
        for before, bit in zip(self.zeros, range(self.bits - 1, -1, -1)):
            l0, r0, one = before[l], before[r], (x >> bit) & 1 == 1
            below += np.where(one, r0 - l0, 0)
            l, r = np.where(one, before[-1] + l - l0, l0), np.where(one, before[-1] + r - r0, r0)
        found = (below < high - low) & (least < self.size)
        l, r, value = low, high, np.zeros(len(low), np.int64)
        for before, bit in zip(self.zeros, range(self.bits - 1, -1, -1)):
            l0, r0 = before[l], before[r]
            one = below >= r0 - l0
            below = below - np.where(one, r0 - l0, 0)
            l, r = np.where(one, before[-1] + l - l0, l0), np.where(one, before[-1] + r - r0, r0)
            value += one.astype(np.int64) << bit
        return np.where(found, value, self.size)


def _candidates(blocks: Blocks, tree: WaveletTree, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`(place, distance)` of blocks of 2^k symbols that occur again as far on as the periods of this level."""
    b = 1 << k
    at = np.arange(0, len(blocks.suffixes) - b + 1, b)
    low, high = blocks.interval(k, at)
    some = high - low > 1
    at, low, high = at[some], low[some], high[some]
    far = np.minimum(at + 4 * b - 2, tree.size - 1)
    hit = tree.successor(low, high, at + (1 if k == 1 else 2 * b - 1))
    while True:
        some = hit <= far
        at, low, high, far, hit = at[some], low[some], high[some], far[some], hit[some]
        if not len(at):
            return
        following = tree.successor(low, high, hit + 1)
        step = following - hit
        row = np.flatnonzero((step <= b // 2) & (following < tree.size))  # heads of progressions
        single = np.ones(len(at), bool)
        if len(row):
            i, first, d = at[row], hit[row], step[row]
            last = (following[row] + blocks.forward(first, following[row]) - b - first) // d
            # Inside the stretch of the block itself, only its own period is smallest.
            own = ((first - i) % d == 0) & (i + d + blocks.forward(i, i + d) >= first + b)
            single[row] = ~own | (first - i == d)
            many = np.where(own, 0, np.minimum(last, (far[row] - first) // d))
            turn = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + 1
            yield np.repeat(i, many), np.repeat(first - i, many) + turn * np.repeat(d, many)
            following[row] = tree.successor(low[row], high[row], first + last * d + 1)
        yield at[single], (hit - at)[single]
        hit = following


def find_runs(symbols: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`(start, end, period)` of all runs, by start and period; the last symbol must occur once."""
    blocks = Blocks(symbols)
    tree = WaveletTree(blocks.suffixes)
    found = []
    # On the last level all names differ; a longer block cannot occur again.
    for k in range(1, len(blocks.names) - 1):
        for at, q in _candidates(blocks, tree, k):
            start, end = at - blocks.backward(at, at + q), at + q + blocks.forward(at, at + q)
            long = end - start >= np.maximum(least, 2 * q)
            found.append(np.stack((start[long], q[long], end[long])))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, q, end = np.concatenate(found, axis=1)
    order = np.lexsort((q, end, start))
    start, q, end = start[order], q[order], end[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, q, end = start[new], q[new], end[new]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def _covered(found: Words, owner: np.ndarray) -> np.ndarray:
    """Which words lie in a six-word window that occurs again in the same text."""
    n = len(owner)
    covered = np.zeros(n, bool)
    if n < 2 * WINDOW:
        return covered
    h = RangeHash(found.data).of(found.start, found.end)
    gram = np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + h[k : n - WINDOW + 1 + k]
    inside = np.flatnonzero(owner[: n - WINDOW + 1] == owner[WINDOW - 1 :])
    key = mix(gram[inside] ^ mix(owner[inside].astype(np.uint64), 9))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(n + 1, np.int64)
    for part in (order[1:][same], order[:-1][same]):
        again[inside[part]] = 1
    # A window covers six words.
    total = np.concatenate(([0], np.cumsum(again[:n])))
    at = np.arange(n)
    return total[at + 1] > total[np.maximum(at + 1 - WINDOW, 0)]


def text_runs(found: Words, least: int = LEAST):
    """`(text, start, end, period)` of the runs of some texts, counted in words of the piece."""
    owner = found.text_of_word()
    covered = _covered(found, owner)
    edge = np.ones(len(owner) + 1, bool)
    if len(owner):
        edge[1:-1] = (covered[1:] != covered[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(edge)
    first, last = first[:-1], first[1:]
    live = (last - first >= least) & covered[np.minimum(first, len(owner) - 1)] if len(owner) else np.zeros(0, bool)
    first, size = first[live], (last - first)[live]
    if not len(first):
        return (np.zeros(0, np.int64),) * 4
    # Each stretch and a separator after it.
    ends = np.cumsum(size + 1)
    place = np.arange(ends[-1]) - np.repeat(ends - size - 1, size + 1) + np.repeat(first, size + 1)
    word = np.ones(ends[-1], bool)
    word[ends - 1] = False
    symbols, at = np.zeros(ends[-1], np.int64), np.flatnonzero(word)
    start, end, names = found.start[place[at]], found.end[place[at]], 0
    for length, group in by_length(start, end):
        some, which = distinct_rows(matrix(found.data, start[group], length))
        symbols[at[group]] = names + which
        names += len(some)
    symbols[ends - 1] = names + np.arange(len(ends))
    s, e, q = find_runs(symbols, least)
    return owner[place[s]], place[s], place[e - 1] + 1, q


def _texts(found: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    use = np.repeat(keep, found.end - found.start + 1)
    kept = np.flatnonzero(keep)
    owner = found.text_of_word()[kept]
    last = np.ones(len(kept), bool)
    last[:-1] = owner[1:] != owner[:-1]
    use[found.end[kept[last]]] = False  # no space after the last word of a text
    total = np.concatenate(([0], np.cumsum(use)))
    bounds = np.append(found.start, len(found.data))[found.first]
    offsets = total[bounds]
    kind, width = (pa.large_string(), np.int64) if offsets[-1] > 2**31 - 1 else (pa.string(), np.int32)
    data = pa.py_buffer(found.data[use].tobytes())
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(width).tobytes()), data])


def collapse(docs: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`(doc_id, n_words, runs, collapsed)` of every row.

    `runs` are structs `(start, length, period)` in words from 0, by start and period.  `collapsed` has the words
    that no run holds after its first period, joined by one space.
    """
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column("text")):
                found = words(data, offsets, lower=False)
                owner, start, end, q = text_runs(found, least)
                drop = np.zeros(len(found.start) + 1, np.int64)
                np.add.at(drop, start + q, 1)
                np.add.at(drop, end, -1)
                at = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=j - i)))).astype(np.int32)
                columns = [pa.array(c, pa.int64()) for c in (start - found.first[owner], end - start, q)]
                runs = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(columns, fields=list(kind)))
                texts = _texts(found, np.cumsum(drop)[:-1] == 0)
                columns = [batch.column("doc_id").slice(i, j - i), pa.array(found.counts(), pa.int64()), runs, texts.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    name = rows.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {name}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return rows.mapInArrow(run, out)
