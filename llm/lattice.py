"""LM scoring with a subword lattice.

The model is a unigram model over the pieces of an existing subword vocabulary.  A text is its
words, each behind a `▁`, and an end; its probability is the sum over all ways to cut its words
into pieces, which a forward recursion in log space gives, word by word (no piece spans two words).

*Scores.*  The vocabulary's own scores are ranks: they start the model as p ~ 1 / (rank + 10).  The words
of the training documents are counted over the whole corpus, and rounds of expectation-maximisation
(forward and backward over each different word, weighted by its count) give each piece its
expected share.  Nothing is pruned, added or renamed: the vocabulary stays as it is.  Letters without
a piece are spelled by the pieces of their UTF-8 bytes, so every text has a probability above zero.
Texts are taken in slices of `SLICE` bytes (or one text); the different words of a slice run through the
recursion together, those of more than `LONG` letters one by one.

*Base.*  Next to it, each text has a base score by whole words: log10((c + 0.5) / (N + 0.5 * (V + 1))).
Counts of the `FREQUENT` most frequent words are sent to all tasks (so many words at most, and
none of more than `WORD_BYTES` bytes); the others are joined.

Null and empty texts have one token, the end.  Repeated rows count as often as they are there.  A null
id is not held out, as crc32 of null is null.  An empty table gives an empty result; without training
documents every count is 0 and the pieces keep their first shares.  Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.scratch import Scratch
from llm.trellis import CHUNK, Layout, Trie

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FREQUENT, WORD_BYTES = 100_000, 64
ROUNDS = 2
SPACE = "▁"
SLICE, LONG = 16 << 20, 64
#: What each piece has besides its expected count, so none is impossible.
PRIOR = 0.01


def load_pieces(path: str) -> tuple[list[str], list[int]]:
    """Pieces of a sentencepiece model, and for bytes 0..255 the number of their piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    pieces = ["" if model.is_control(i) or model.is_unknown(i) else model.id_to_piece(i) for i in range(size)]
    spelled = [0] * 256
    for i in range(size):
        if model.is_byte(i):
            spelled[int(pieces[i][1:-1], 16)] = i
            pieces[i] = ""
    return pieces, spelled


def first_shares(pieces: list[str], spelled: list[int]) -> np.ndarray:
    """Shares by rank; the last one is that of the end of a text."""
    share = 1.0 / (np.arange(len(pieces)) + 10.0)
    usable = np.array([bool(p) for p in pieces])
    usable[spelled] = True
    share[~usable] = 0.0
    share = np.append(share, share.max())
    return share / share.sum()


class Lattice:
    """Marginal log10 probabilities of words."""

    def __init__(self, pieces: list[str], spelled: list[int], shares: np.ndarray):
        logs = np.log(np.maximum(shares, 1e-300)).tolist()
        self.pieces = {p: (logs[i], i) for i, p in enumerate(pieces) if p}
        #: Beginnings of pieces: where a string is none of these, no longer piece starts with it.
        self.starts = {p[:k] for p in self.pieces for k in range(1, len(p))}
        self.byte = [logs[i] for i in spelled]
        self.spelled = spelled
        self.end = logs[-1] / math.log(10)

    def arcs(self, word: str) -> list:
        """For each place the arcs that end there: `(from, log share, number of the piece)`.

        The number is -1 for a letter that is spelled by bytes.
        """
        pieces, starts, n = self.pieces, self.starts, len(word)
        out = [[] for _ in range(n)]
        for i in range(n):
            if word[i] not in pieces:
                out[i].append((i, sum(self.byte[b] for b in word[i].encode("utf-8", "surrogatepass")), -1))
            for j in range(i + 1, n + 1):
                part = word[i:j]
                found = pieces.get(part)
                if found is not None:
                    out[j - 1].append((i, *found))
                if part not in starts:
                    break
        return out

    @staticmethod
    def forward(arcs: list) -> list[float]:
        alpha = [0.0] * (len(arcs) + 1)
        for j, found in enumerate(arcs, 1):
            if len(found) == 1:
                i, s, _ = found[0]
                alpha[j] = alpha[i] + s
            else:
                values = [alpha[i] + s for i, s, _ in found]
                top = max(values)
                alpha[j] = top + math.log(sum([math.exp(v - top) for v in values]))
        return alpha

    def score(self, word: str) -> float:
        """log10 of the marginal probability of the word."""
        return self.forward(self.arcs(SPACE + word))[-1] / math.log(10)

    def expect(self, word: str, weight: float, counts: list | np.ndarray) -> None:
        """Add the expected number of each piece in `weight` copies of the word."""
        word = SPACE + word
        arcs = self.arcs(word)
        alpha = self.forward(arcs)
        total = alpha[-1]
        beta = [-math.inf] * (len(word) + 1)
        beta[-1] = 0.0
        for j in range(len(word), 0, -1):
            b, found = beta[j], arcs[j - 1]
            if b == -math.inf:
                continue
            for i, s, k in found:
                x = b + s
                old = beta[i]
                if old == -math.inf:
                    beta[i] = x
                else:
                    beta[i] = max(old, x) + math.log1p(math.exp(-abs(old - x)))
                share = weight * math.exp(alpha[i] + x - total)
                if k >= 0:
                    counts[k] += share
                else:
                    for byte in word[i:j].encode("utf-8", "surrogatepass"):
                        counts[self.spelled[byte]] += share


class Words:
    """The sums of `Lattice` for lists of words."""

    def __init__(self, pieces: list[str], spelled: list[int], shares: np.ndarray):
        self.one = Lattice(pieces, spelled, shares)
        self.trie = Trie(pieces)
        self.logs = np.log(np.maximum(shares[: len(pieces)], 1e-300))

    def _layouts(self, words: list[str]) -> Iterator[tuple[np.ndarray, Layout, np.ndarray]]:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] <= LONG]
        for k in range(0, len(order), CHUNK):
            part = order[k : k + CHUNK]
            layout = Layout([SPACE + words[i] for i in part.tolist()], self.trie)
            odd = [sum(self.one.byte[b] for b in chr(c).encode("utf-8", "surrogatepass")) for c in layout.odd.tolist()]
            yield part, layout, np.concatenate([self.logs, odd])

    def score(self, words: list[str]) -> np.ndarray:
        """log10 of the marginal probability of each word."""
        out = np.empty(len(words))
        for part, layout, logs in self._layouts(words):
            out[part[layout.order]] = layout.totals(layout.forward(logs, layout.arcs())) / math.log(10)
        for i, word in enumerate(words):
            if len(word) > LONG:
                out[i] = self.one.score(word)
        return out

    def expect(self, words: list[str], weights: np.ndarray, counts: np.ndarray) -> None:
        """Add the expected number of each piece in so many copies of the words."""
        for part, layout, logs in self._layouts(words):
            found = layout.expected(logs, weights[part])
            counts += found[: len(counts)]
            for letter, n in zip(layout.odd.tolist(), found[len(counts) :]):
                for byte in chr(letter).encode("utf-8", "surrogatepass"):
                    counts[self.one.spelled[byte]] += n
        for i, word in enumerate(words):
            if len(word) > LONG:
                self.one.expect(word, float(weights[i]), counts)


def slices(batch: pa.RecordBatch, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have at most so many bytes, or are one text."""
    sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
    start = total = 0
    for k, n in enumerate(sizes.tolist()):
        if total and total + n > size:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def lower(text: Column) -> Column:
    capital = "".join(map(chr, range(65, 91)))
    return F.translate(text, capital, capital.lower())


def word_list(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` in lower case (A-Z only)."""
    spaced = F.translate(lower(text), "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """`(word, c)` over all texts."""
    return docs.select(F.explode(word_list(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("c"))


def train(counts: DataFrame, texts: int, path: str = VOCABULARY, rounds: int = ROUNDS) -> np.ndarray:
    """Shares of the pieces, and of the end at last, by expectation-maximisation over all counted words."""
    pieces, spelled = load_pieces(path)
    shares = first_shares(pieces, spelled)
    spark = counts.sparkSession

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(shares)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            net, counts = Words(pieces, spelled, shared.value), np.zeros(len(pieces))
            for batch in batches:
                net.expect(batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(float), counts)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["piece", "n"])

        found = counts.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        got = np.zeros(len(shares))
        for row in found:  # one row for each piece of the vocabulary at most
            got[row.piece] = round(row.n, 3)
        got[-1] = texts
        if got.sum():
            got = np.where(shares > 0, got + PRIOR, 0.0)
            shares = got / got.sum()
        shared.unpersist()
    return shares


def score(
    docs: DataFrame, held_out: Column, path: str = VOCABULARY, rounds: int = ROUNDS, key: str = "doc_id", text: str = "text",
    frequent: int = FREQUENT,
) -> DataFrame:
    """`(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)` for each row of `docs`.

    Where `held_out` is not true, the text is learned from.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lattice")
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    learned = rows.where(~F.col("held_out"))
    counts = scratch.save(count_words(learned), "counts")
    texts = learned.count()
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    train_tokens = int(sums.n or 0) + texts
    different = int(sums.v) + (texts > 0)
    below = math.log10(train_tokens + 0.5 * (different + 1))

    shares = spark.sparkContext.broadcast(train(counts, texts, path, rounds))
    short = counts.where(F.octet_length("word") <= WORD_BYTES)
    most = short.orderBy(F.desc("c"), "word").limit(frequent)
    found = [(r.word, r.c) for r in most.toLocalIterator()]
    least = min((c for _, c in found), default=0)
    pieces, spelled = load_pieces(path)
    words = [w for w, _ in found]
    base = np.log10(np.array([c for _, c in found], dtype=float) + 0.5) - below
    known = spark.sparkContext.broadcast(({w: k for k, w in enumerate(words)}, base, Words(pieces, spelled, shares.value).score(words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Words(pieces, spelled, shares.value)
        places, bases, marginals = known.value
        end = math.log10(texts + 0.5) - below
        for batch in batches:
            for part in slices(batch):
                lists = pc.ascii_split_whitespace(pc.ascii_lower(part.column("text")))
                row, words = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
                real = pc.not_equal(words, "")
                row, words = row[real.to_numpy(zero_copy_only=False)], words.filter(real).dictionary_encode()
                code, words = words.indices.to_numpy(), words.dictionary
                different = words.to_pylist()
                place = np.fromiter((places.get(w, -1) for w in different), dtype=np.int64, count=len(different))
                frequent, rare = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
                base_of, score_of = np.zeros(len(different)), np.empty(len(different))
                base_of[frequent], score_of[frequent] = bases[place[frequent]], marginals[place[frequent]]
                score_of[rare] = net.score([different[k] for k in rare.tolist()])
                n = part.num_rows
                total = lambda weights: np.bincount(row, weights, n)  # noqa: E731, B023
                is_known = place[code] >= 0
                other = np.flatnonzero(~is_known)
                pairs, times = np.unique(row[other].astype(np.int64) * max(1, len(different)) + code[other], return_counts=True)
                rare_row, rare_code = np.divmod(pairs, max(1, len(different)))
                offsets = np.concatenate([[0], np.cumsum(np.bincount(rare_row, minlength=n))]).astype(np.int32)
                left = pa.StructArray.from_arrays([words.take(pa.array(rare_code)), pa.array(times)], ["word", "n"])
                arrays = {
                    "doc_id": part.column("doc_id"),
                    "held_out": part.column("held_out"),
                    "n_tokens": pa.array(np.bincount(row, minlength=n) + 1),
                    "n_known": pa.array(total(is_known).astype(np.int64) + int(texts > 0)),
                    "base_score": pa.array(total(base_of[code]) + end),
                    "score": pa.array(total(score_of[code]) + net.one.end),
                    "rare": pa.ListArray.from_arrays(pa.array(offsets), left),
                }
                yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<word:string,n:bigint>>"
    part = rows.select("doc_id", "held_out", "text").mapInArrow(run, schema)
    # A number for each row, fixed when the table is written.
    part = scratch.save(part.withColumn("_row", F.monotonically_increasing_id()), "part")
    # Words beyond the frequent ones: unknown ones are told by the join too.
    rare = part.select("_row", F.inline("rare")).select("_row", F.col("word"), "n")
    others = counts.where((F.col("c") <= least) | (F.octet_length("word") > WORD_BYTES))
    c = F.coalesce("c", F.lit(0))
    more = rare.join(others, "word", "left").groupBy("_row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known_more"),
        F.sum(F.col("n") * (F.log10(c + 0.5) - F.lit(below))).alias("base_more"),
    )
    return part.drop("rare").join(more, "_row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("known_more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base_more", F.lit(0.0))).alias("base_score"),
        "score",
    )
