"""CRC matrices against zlib, and the resampling against a plain computation."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import targeting
from llm.crcmatrix import BLOCK, crc32
from llm.queries import QUERIES


def test_crc32():
    random_ = np.random.default_rng(3)
    sizes = [0, 1, 2, 3, 3, 7, 8, 9, 9, 17, BLOCK - 1, BLOCK, BLOCK + 1, 2 * BLOCK, 5001, 70_000]
    strings = [random_.integers(0, 256, n, dtype=np.uint8).tobytes() for n in sizes] + [b"same", b"same", b"long" * 200]
    data, end = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([len(s) for s in strings])
    assert crc32(data, end - [len(s) for s in strings], end).tolist() == [zlib.crc32(s) for s in strings]
    assert crc32(data, end[:0], end[:0]).tolist() == []


def features(text, longest):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, longest=1, buckets=10_000, least=20, percent=10, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    raw = Counter(bucket(f) for _, t in docs for f in features(t, longest)[1])
    want = Counter(bucket(f) for t in target for f in features(t, longest)[1])
    s, t = sum(raw.values()), sum(want.values())
    out, can = [], []
    for k, text in docs:
        n, found = features(text, longest)
        gain = [math.floor(1000 * math.log((want[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in map(bucket, found)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([k, len(found), weight, score, None])
        if n >= least:
            can.append((-score, (k is not None, k or 0), len(found), weight, len(out) - 1))
    for place, row in enumerate(sorted(can)[: percent * len(can) // 100]):
        out[row[-1]][-1] = place + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize(("longest", "percent", "least"), [(1, 10, 20), (3, 100, 1), (2, 33, 5), (1, 0, 20)])
def test_resample(spark, documents, rows, folder, longest, percent, least):
    target = spark.read.parquet(f"{folder}/benchmark.parquet")
    got = targeting.resample(documents, target, longest, 997, least, percent, 5).drop("n_words").collect()
    texts = [r.text for r in target.collect()]
    assert sorted(map(tuple, got), key=str) == brute([(r.doc_id, r.text) for r in rows], texts, longest, 997, least, percent, 5)


def test_op13(spark, folder, rows):
    got = QUERIES["op13_crc_resampling"](spark, folder).collect()
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert sorted(map(tuple, got), key=str) == brute([(r.doc_id, r.text) for r in rows], target)


def test_ties_clashing_columns_and_no_rows(spark, documents):
    """Equal texts without ids score the same; extra columns have names of the result."""
    rows = spark.range(64).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c " * 9).alias("text"), F.lit(1).alias("rank"), F.lit(2).alias("_place"))
    got = targeting.resample(rows, documents, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 33)) and len({r.score for r in got}) == 1
    assert targeting.resample(rows.limit(0), documents).collect() == []
    assert targeting.resample(rows, documents.limit(0)).count() == 64
