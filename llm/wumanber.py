"""Benchmark decontamination by Wu-Manber search for many strings at once.

Windows of benchmark words are the search strings, as words with one space before, between and
behind them; documents are brought into the same form, so a match is a match of whole words.

The search looks at blocks of bytes.  Positions stand at the end of the shortest string laid over
the text.  The *shift table* has for each block (by a hash of `TABLE_BITS` bits) how far the
position can move on without missing a string; most blocks of ordinary text are in no string and
allow a move by nearly the whole length.  Where the shift is zero, the *bucket* of the block lists
the strings that have it there; their first bytes and then all their bytes are compared.  All
segments of a piece of text are searched side by side, one move of each at a time.

Strings are handled in sets of up to `SET_BYTES` bytes (strings of very different lengths in
different sets, so a short one does not shorten the moves of the others), each of which is shared
with the executors; documents are searched for one set after another.  So what is broadcast has a
bound, however many items there are.

Null and empty texts and texts without words have no words, no hits and, as items, no windows.
An item of fewer than `width` words is one window, all its words.  Items that repeat count once; an
item with a null id marks words as hit but is not listed.  Documents are rows: equal ids do not
matter.  An empty table of items marks nothing.  Other columns are passed on by `decontaminate`
only where they are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.textops import ALNUM, Words, column_bytes, mix, pieces, words

WIDTH = 10
TABLE_BITS = 20
SET_BYTES = 1 << 24
#: Bytes of text that one searcher of a piece walks through.
SEGMENT = 256


def spaced(found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with a space before the first one; starts of words in it; ends."""
    return np.concatenate((np.full(1, 32, np.uint8), found.data)), found.start + 1, found.end + 1


class Searcher:
    """Shift table, buckets and strings of one set; every string has `least` bytes or more."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.size = np.array([len(s) for s in strings], np.int64)
        self.least = int(self.size.min())
        self.block = min(10, self.least)
        self.head = min(8, self.least)
        data = np.frombuffer(b"".join(strings), np.uint8)
        self.start = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        reach = self.least - self.block + 1
        # Blocks of the first `least` bytes of each string, from left to right.
        at = self.start[:, None] + np.arange(reach)
        slots = self._slots(data, at.ravel()).reshape(at.shape)
        self.shift = np.full(1 << TABLE_BITS, min(reach, 65_000), np.uint16)
        for j in range(reach):
            np.minimum.at(self.shift, slots[:, j], min(reach - 1 - j, 65_000))
        # Strings by the block at the end of their first `least` bytes.
        last = slots[:, -1]
        self.by_slot = np.argsort(last, kind="stable")
        self.slots, first = np.unique(last[self.by_slot], return_index=True)
        self.first = np.append(first, len(last))
        self.heads = self._prefix(data, self.start)
        self.data = data

    def _slots(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for k in range(self.block):
            h = h * np.uint64(0x100000001B3) + data[at + k]
        return (mix(h) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def _prefix(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for k in range(self.head):
            h = (h << np.uint64(8)) | data[at + k]
        return h

    def search(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start in `data` and number of each string that occurs, in no order."""
        none = np.zeros(0, np.int64)
        last = len(data) - self.least
        if last < 0:
            return none, none
        # `at` is where the shortest string would start; each searcher has its own segment of starts.
        at = np.arange(0, last + 1, SEGMENT)
        stop = np.minimum(at + SEGMENT, last + 1)
        reach = self.least - self.block
        places, names = [], []
        while len(at):
            slot = self._slots(data, at + reach)
            shift = self.shift[slot].astype(np.int64)
            stay = shift == 0
            if stay.any():
                where, slots = at[stay], slot[stay]
                k = np.searchsorted(self.slots, slots)
                k[k == len(self.slots)] = 0
                sure = self.slots[k] == slots
                where, k = where[sure], k[sure]
                many = self.first[k + 1] - self.first[k]
                place = np.repeat(where, many)
                inside = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)
                name = self.by_slot[np.repeat(self.first[k], many) + inside]
                near = (place + self.size[name] <= len(data)) & (self._prefix(data, place) == self.heads[name])
                for p, s in zip(place[near].tolist(), name[near].tolist()):
                    if data[p : p + self.size[s]].tobytes() == self.strings[s]:
                        places.append(p)
                        names.append(s)
            at = at + np.maximum(shift, 1)
            go = at < stop
            at, stop = at[go], stop[go]
        return np.array(places, np.int64), np.array(names, np.int64)


def windows(items: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """`(string, items)`: the different windows of the items, and the ids that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column("text")):
                found = words(data, offsets, ALNUM)
                whole, start, end = spaced(found)
                counts = found.counts()
                many = np.maximum(counts - width + 1, np.minimum(counts, 1))
                first = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - found.first[:-1], many)
                last = np.minimum(first + width, np.repeat(found.first[1:], many)) - 1
                view = whole.tobytes()
                strings = [view[a - 1 : b + 1] for a, b in zip(start[first].tolist(), end[last].tolist())]
                owner = pa.array(np.repeat(np.arange(i, j), many))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(strings, pa.binary()), batch.column("item").take(owner)], ["string", "item"]
                )

    rows = items.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "string binary, item string").groupBy("string").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _sets(found: DataFrame, limit: int) -> Iterator[list]:
    """Rows of `windows` in sets of strings of similar length, up to `limit` bytes each."""
    size, rows, kind = 0, [], None
    by = F.floor(F.log2(F.octet_length("string")) * 2)
    for row in found.select("string", "items", by.alias("kind")).orderBy("kind", "string").toLocalIterator():
        if rows and (size >= limit or row.kind != kind):
            yield rows
            size, rows = 0, []
        kind = row.kind
        rows.append((bytes(row.string), row["items"]))
        size += len(row.string) + sum(map(len, row["items"]))
    if rows:
        yield rows


_RESULT = "n_words long, n_hit long, items array<string>"


def _search(shared: list, keep: list[str]):
    """Count the words, the words hit and the items of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [(Searcher([s for s, _ in x.value]), [i for _, i in x.value]) for x in shared]
        for batch in batches:
            n_words, n_hit, items = [], [], []
            for _, _, data, offsets in pieces(batch.column("text")):
                found = words(data, offsets, ALNUM)
                # Two spaces before each text but the first: no string spans two texts.
                gap = np.searchsorted(found.first[1:-1], np.arange(len(found.start)), side="right")
                whole = np.full(len(found.data) + len(offsets), 32, np.uint8)
                length = found.end - found.start
                shift = np.repeat(gap + 1, length + 1)
                whole[np.arange(len(found.data)) + shift] = found.data
                start = found.start + gap + 1
                counts = found.counts()
                step = np.zeros(len(start) + 1, np.int64)
                named = [set() for _ in range(len(counts))]
                owner = found.text_of_word()
                for searcher, names in sets:
                    place, name = searcher.search(whole)
                    a = np.searchsorted(start, place + 1)
                    b = np.searchsorted(start, place + searcher.size[name])
                    np.add.at(step, a, 1)
                    np.add.at(step, b, -1)
                    for o, s in set(zip(owner[a].tolist(), name.tolist())):
                        named[o].update(names[s])
                hit = np.concatenate(([0], np.cumsum(np.cumsum(step)[:-1] > 0)))
                n_words.append(counts)
                n_hit.append(hit[found.first[1:]] - hit[found.first[:-1]])
                items += [sorted(x) for x in named]
            join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), join(n_words), join(n_hit), pa.array(items, pa.list_(pa.string()))],
                [*keep, "n_words", "n_hit", "items"],
            )

    return run


def decontaminate(
    docs: DataFrame, items: DataFrame, width: int = WIDTH, key: str = "item_id", text: str = "text", set_bytes: int = SET_BYTES
) -> DataFrame:
    """The columns of `docs` but `n_words`, `n_hit`, `items`, which hold what was found in `text`.

    `n_hit` counts the words of the document inside any occurrence of a window of `width`
    words of an item, `items` are the ids of those items, as strings, sorted.
    """
    spark = docs.sparkSession
    shared = [spark.sparkContext.broadcast(rows) for rows in _sets(windows(items, width, key, text), set_bytes)]
    keep = [c for c in docs.columns if c not in ("n_words", "n_hit", "items")]
    rows = docs.select(*keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), _RESULT])
    return rows.mapInArrow(_search(shared, keep), schema)
