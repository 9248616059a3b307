"""Forward and backward recursion over the segmentations of many words at once.

Words are laid out as code points, longest first, so the words that reach a place are the first ones of
the layout.  From each place all words walk a trie of the pieces together, one letter a step; a word
leaves the walk where no piece goes on.  The trie is a hash table of (node, letter) in numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words of one layout.
CHUNK = 16_384
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Trie:
    """Pieces as nodes; node 0 is the root, `piece[node]` the number of the piece that ends there or -1."""

    def __init__(self, pieces: list[str]):
        edges, piece = {}, [-1]
        for number, text in enumerate(pieces):
            node = 0
            for letter in text:
                key = node << 21 | ord(letter)
                node = edges.get(key, 0)
                if not node:
                    node = edges[key] = len(piece)
                    piece.append(-1)
            if node:
                piece[node] = number
        self.piece = np.array(piece, dtype=np.int64)
        self.count, self.longest = len(pieces), max(map(len, pieces), default=0)
        keys = np.fromiter(edges, dtype=np.int64, count=len(edges))
        children = np.fromiter(edges.values(), dtype=np.int64, count=len(edges))
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.children = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int64)
        todo, slots = np.arange(len(keys)), self._slots(keys)
        while todo.size:
            at = slots[todo]
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[todo[free]]
            placed = self.keys[at] == keys[todo]
            self.children[at[placed]] = children[todo[placed]]
            todo = todo[~placed]
            slots[todo] = (slots[todo] + 1) & self.last

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The children of the nodes along the letters, 0 where there is none."""
        keys = nodes << 21 | letters
        slots = self._slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.children[slots], 0)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while left.size:
            slots[left] = (slots[left] + 1) & self.last
            found = self.keys[slots[left]]
            hit = found == keys[left]
            out[left[hit]] = self.children[slots[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


class Layout:
    """Words, not empty, as one array of code points, longest first."""

    def __init__(self, words: list[str], trie: Trie):
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        text = "".join([words[k] for k in self.order.tolist()])
        self.letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.trie = trie
        every = np.unique(self.letters)
        #: Letters that are no piece.
        self.odd = every[trie.piece[trie.step(np.zeros_like(every), every)] < 0]

    def arcs(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """`(place, length, words, pieces)` by place; odd letters are numbered behind the pieces."""
        trie, count = self.trie, len(self.sizes)
        behind = -self.sizes
        for place in range(int(self.sizes[0]) if count else 0):
            words = np.arange(np.searchsorted(behind, -place, side="left"))
            nodes = np.zeros(len(words), dtype=np.int64)
            for length in range(1, trie.longest + 1):
                if length > 1:
                    inside = self.sizes[words] >= place + length
                    words, nodes = words[inside], nodes[inside]
                if not words.size:
                    break
                letters = self.letters[self.starts[words] + (place + length - 1)]
                nodes = trie.step(nodes, letters)
                pieces = trie.piece[nodes]
                if length == 1:
                    alone = pieces < 0
                    if alone.any():
                        yield place, 1, words[alone], trie.count + np.searchsorted(self.odd, letters[alone])
                hit = pieces >= 0
                if hit.any():
                    yield place, length, words[hit], pieces[hit]
                going = nodes > 0
                words, nodes = words[going], nodes[going]

    def forward(self, logs: np.ndarray, arcs) -> np.ndarray:
        """Log sums over the ways to each place, places by words."""
        alpha = np.full((int(self.sizes[0]) + 1, len(self.sizes)), -np.inf)
        alpha[0] = 0.0
        for place, length, words, pieces in arcs:
            end = alpha[place + length]
            end[words] = np.logaddexp(end[words], alpha[place, words] + logs[pieces])
        return alpha

    def totals(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[self.sizes, np.arange(len(self.sizes))]

    def expected(self, logs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The expected number of each piece (odd letters behind them) in `weights` copies of the words."""
        arcs = list(self.arcs())
        alpha = self.forward(logs, arcs)
        totals, weights = self.totals(alpha), weights[self.order]
        beta = np.full(alpha.shape, -np.inf)
        beta[self.sizes, np.arange(len(self.sizes))] = 0.0
        counts = np.zeros(len(logs))
        for place, length, words, pieces in reversed(arcs):
            after = beta[place + length, words] + logs[pieces]
            start = beta[place]
            start[words] = np.logaddexp(start[words], after)
            counts += np.bincount(pieces, weights[words] * np.exp(alpha[place, words] + after - totals[words]), len(logs))
        return counts
