"""Importance resampling towards a target distribution, on buckets of CRC-32 codes.

Features are runs of 1 to `longest` consecutive words, joined by one space; the bucket of a feature is its CRC-32
modulo `buckets`.  The codes come from `crcmatrix`: features of equal length are rows of a byte matrix, all
codes of a matrix are updated column by column and put back in place.

The gain of a bucket is floor(1000 * ln(target share / raw share)), with one added to each count; the
weight of a document is the floored mean of the gains of its features, and its score adds a Gumbel variable
drawn from SHA-256 of `seed:doc_id`, so the largest scores are a sample without replacement in
proportion to the weights.

Counts and ranks cover all rows.  What reaches the driver is one row for each bucket and one for each
distinct score (scores are whole numbers in a range that does not grow with the table); the rest is
sorted by range only where it is drawn.

Null and empty texts, and texts without words, have no features, weight 0 and a score; they are
never drawn.  A null id is the empty string in the seed and comes before others in ties.  Repeated rows are
documents of their own; rows with equal score and id are ordered by features and weight, so results
agree between runs.  Without target texts all gains come from the raw side alone.  An empty table gives an
empty result.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.crcmatrix import crc32
from llm.scratch import Scratch
from llm.textops import ALNUM, pieces, words

BUCKETS = 10_000


def feature_buckets(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int):
    """`(bucket of each feature, text of each feature, number of words of each text)`."""
    found = words(data, offsets, ALNUM)
    owner, counts = found.text_of_word(), found.counts()
    left = found.first[1:][owner] - np.arange(len(owner))  # words from here to the end of the text
    bucket, of = [], []
    for n in range(1, longest + 1):
        begin = np.flatnonzero(left >= n)
        codes = crc32(found.data, found.start[begin], found.end[begin + n - 1])
        bucket.append(codes.astype(np.int64) % buckets)
        of.append(owner[begin])
    return np.concatenate(bucket), np.concatenate(of), counts


def bucket_counts(texts: DataFrame, longest: int, buckets: int, text: str = "text") -> np.ndarray:
    """How many features of all texts are in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0)):
                total += np.bincount(feature_buckets(data, offsets, longest, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored log ratios of the shares of the buckets, in thousandths."""
    size = float(len(raw))
    ratio = (target + 1.0) * (float(raw.sum()) + size) / ((raw + 1.0) * (float(target.sum()) + size))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int, key: str, text: str) -> DataFrame:
    """`(doc_id, n_words, n_features, weight)` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column("text")):
                bucket, owner, counts = feature_buckets(data, offsets, longest, len(shared.value))
                many = np.bincount(owner, minlength=j - i)
                before = np.concatenate(([0], np.cumsum(shared.value[bucket[np.argsort(owner, kind="stable")]])))
                ends = np.concatenate(([0], np.cumsum(many)))
                mean = (before[ends[1:]] - before[ends[:-1]]) // np.maximum(many, 1)
                columns = [batch.column("doc_id").slice(i, j - i), *(pa.array(c, pa.int64()) for c in (counts, many, mean))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def with_score(weighted: DataFrame, seed: int) -> DataFrame:
    """Add `score`, the weight plus a Gumbel variable in thousandths."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return weighted.withColumn("score", F.col("weight") + gumbel)


def draw(scored: DataFrame, eligible: str, percent: int, scratch: Scratch) -> DataFrame:
    """Add `rank` to the top `percent` of the rows where `eligible` holds; null for the others.

    `scored` is a written table with a `score`.  A histogram of scores gives the lowest one that can be
    drawn; only rows from there on are sorted, by range, and numbered.
    """
    rest = [F.col(c).asc() for c in ("doc_id", "n_features", "weight", "n_words")]
    can = scored.where(eligible)
    # One row for each whole number that occurs as a score.
    bars = sorted(((r.score, r.n) for r in can.groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    want = percent * sum(n for _, n in bars) // 100
    lowest, seen = None, 0
    for score, n in bars:
        if seen >= want:
            break
        lowest, seen = score, seen + n
    inside = F.lit(False) if lowest is None else F.coalesce(F.expr(eligible), F.lit(False)) & (F.col("score") >= lowest)
    ordered = scored.where(inside).orderBy(F.desc("score"), *rest).withColumn("_place", F.monotonically_increasing_id())
    ordered = scratch.save(ordered, "ordered")
    part = F.shiftright("_place", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # One row for each partition of the sort.
    numbered = ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    place = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1
    rank = F.when(place <= want, place).cast("long").alias("rank")
    return numbered.select(*scored.columns, rank).union(scored.where(~inside).select("*", F.lit(None).cast("long")))


def resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = 1,
    buckets: int = BUCKETS,
    least_words: int = 20,
    percent: int = 10,
    seed: int = 2024,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """`(doc_id, n_words, n_features, weight, score, rank)` for each row of `docs`.

    `target` holds texts like the wanted ones, in a column of the same name.  Of the documents with at least
    `least_words` words, `percent` of 100 are drawn; `rank` counts them from 1.
    """
    scratch = Scratch(docs.sparkSession, "targeting")
    gain = gains(bucket_counts(docs, longest, buckets, text), bucket_counts(target, longest, buckets, text))
    scored = scratch.save(with_score(weigh(docs, gain, longest, key, text), seed), "scored")
    return draw(scored, f"n_words >= {least_words}", percent, scratch)
