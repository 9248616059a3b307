"""Quality selection by importance resampling.

Two bag-of-n-grams models over `BUCKETS` hashed buckets of words and word pairs: one of the target
texts, one of all raw texts.  The log weight of a document is the sum over its n-grams of the log ratio of
the two shares of their bucket.  Adding a Gumbel variable (drawn from a hash of the id) to each log
weight and taking the largest k is sampling of k documents without replacement with
probabilities in proportion to the weights.

The counts of the raw model cover all documents.  The target model is fitted on up to `SAMPLE` labelled
rows, those with the smallest hash of their id; only these ids are broadcast.  What reaches the driver
is one row for each bucket.

A text without words has log weight 0.  Null texts are empty.  A null id has a Gumbel variable like any
other.  Repeated rows have equal weights and keys and are separate documents.  Without target rows all
log weights are 0.  An empty table gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.scratch import Scratch
from llm.textops import pieces, words
from wordloom.runtime import number_rows

BUCKETS = 10_000
SAMPLE = 50_000


def gram_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of some texts, and the text of each."""
    found = words(data, offsets)
    hashes, owner = [], []
    for n in (1, 2):
        h, at = found.grams(n, shorter=False)
        hashes.append(h)
        owner.append(np.repeat(np.arange(len(at) - 1), np.diff(at)))
    h = np.concatenate(hashes)
    return (h % np.uint64(buckets)).astype(np.int64), np.concatenate(owner)


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            target = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
            for i, j, data, offsets in pieces(batch.column("text")):
                bucket, owner = gram_buckets(data, offsets, buckets)
                total[0] += np.bincount(bucket, minlength=buckets)
                total[1] += np.bincount(bucket[target[i:j][owner]], minlength=buckets)
        columns = [pa.array(np.arange(buckets)), pa.array(total[0]), pa.array(total[1])]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "raw", "target"])

    return run


def log_ratios(docs: DataFrame, buckets: int = BUCKETS, smooth: float = 1.0) -> np.ndarray:
    """log of (share in the target texts / share in all texts) of each bucket; `docs (text, target)`."""
    found = docs.select("text", "target").mapInArrow(_count(buckets), "bucket long, raw long, target long")
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in found.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return np.zeros(buckets)
    share = lambda x: (x + smooth) / (x.sum() + smooth * buckets)
    return np.log(share(target)) - np.log(share(raw))


def resample(
    docs: DataFrame,
    target: DataFrame,
    k: int,
    buckets: int = BUCKETS,
    sample: int = SAMPLE,
    seed: int = 7,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """`(doc_id, n_grams, log_weight, gumbel_key, place, selected)` for each row of `docs`.

    `target (doc_id)` are the ids of texts like the wanted ones; `k` documents are selected.
    `place` is the rank by falling key, from 1.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "resampling")
    chosen = target.select(F.col(key).alias("_id")).where("_id is not null").distinct()
    # At most `sample` ids, which bounds what is broadcast.
    chosen = scratch.save(chosen.orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(sample), "target")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    marked = rows.join(F.broadcast(chosen.withColumn("target", F.lit(True))), F.col("doc_id") == F.col("_id"), "left")
    ratios = spark.sparkContext.broadcast(log_ratios(marked.select("text", F.coalesce("target", F.lit(False)).alias("target")), buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many, weight = [np.zeros(0, np.int64)], [np.zeros(0)]
            for _, _, data, offsets in pieces(batch.column("text")):
                bucket, owner = gram_buckets(data, offsets, buckets)
                many.append(np.bincount(owner, minlength=len(offsets) - 1))
                weight.append(np.bincount(owner, ratios.value[bucket], minlength=len(offsets) - 1))
            columns = [batch.column("doc_id"), pa.array(np.concatenate(many), pa.int64()), pa.array(np.concatenate(weight), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_grams", "log_weight"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    weighted = rows.mapInArrow(run, f"doc_id {kind}, n_grams long, log_weight double")
    # A uniform number in (0, 1) from 52 bits of a hash.
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed + 1)), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = weighted.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u)))
    ranked = number_rows(keyed, [F.desc("gumbel_key"), F.col("doc_id")], "place", start=1)
    return ranked.select("doc_id", "n_grams", "log_weight", "gumbel_key", "place", (F.col("place") <= k).alias("selected"))
