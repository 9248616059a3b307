"""Near duplicates and repeated strings against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import minhash, repeats
from llm.components import components
from llm.queries import QUERIES
from llm.scratch import Scratch
from llm.suffixes import suffix_array


def shingles(text, width=5):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, percent):
    """Component of each row; rows that share an id are one node."""
    sets = [(r.doc_id, shingles(r.text)) for r in rows]
    low = {k: k for k, _ in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets:
            for b, y in sets:
                if low[a] != low[b] and x and y and 100 * len(x & y) >= percent * len(x | y):
                    small = min(low[a], low[b], key=lambda k: (k is not None, k or 0))
                    low = {k: small if v in (low[a], low[b]) else v for k, v in low.items()}
                    changed = True
    return sets, low


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(documents, rows, percent):
    unique = [r for r in rows if not (r.doc_id == 5 and rows.index(r) > [x.doc_id for x in rows].index(5))]
    docs = documents.sparkSession.createDataFrame(unique, documents.schema)
    got = sorted(map(tuple, minhash.near_duplicates(docs, percent).collect()), key=str)
    sets, low = brute(unique, percent)
    assert got == sorted([(k, len(s), low[k], k == low[k]) for k, s in sets], key=str)


def test_near_duplicates_of_a_group_where_the_smallest_is_no_centre(spark):
    """Texts in a chain: each is close to the next one only, so the first star misses most links."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 6 : i * 6 + 100])) for i in range(40)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert {r.component_id for r in got} == {0}


def test_near_duplicates_through_repeated_ids(documents, rows):
    """Links pass through an id with several texts, also where it is not the smallest of their classes."""
    x, y, z = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    more = [(503, x), (505, x), (505, y), (507, y), (507, ""), (507, z), (509, z + " end"), (510, z + " end"), (511, None)]
    extra = documents.sparkSession.createDataFrame([(*r, "en", "s0", 1) for r in more], documents.schema)
    got = sorted(map(tuple, minhash.near_duplicates(documents.union(extra), 85).collect()), key=str)
    sets, low = brute(rows + extra.collect(), 85)
    assert low[510] == 503 and got == sorted([(k, len(s), low[k], k == low[k]) for k, s in sets], key=str)


def test_bands_follow_the_percentage(spark):
    """3,000 pairs of similarity 0.80 exactly; bands laid out for 0.85 lose about one in 230 of them."""
    rows = []
    for i in range(3000):
        words = [f"p{i}w{j}" for j in range(94)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:84] + [f"q{i}w{j}" for j in range(10)]))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()
    assert [r for r in got if r.component_id != r.doc_id // 2 * 2] == []
    for percent in (70, 80, 85, 90):
        assert minhash.miss(percent, minhash.BINS, minhash.band_rows(percent)) <= 3e-5


def test_near_duplicates_empty(nothing):
    assert minhash.near_duplicates(nothing).collect() == []


def test_sketches_agree_as_often_as_sets_do():
    pick = np.random.default_rng(1)
    for n, shared in ((400, 340), (40, 34)):
        total = 0
        for _ in range(30):
            x = pick.integers(0, 2**64, 2 * n - shared, dtype=np.uint64)
            a, b = np.sort(x[:n]), np.sort(x[n - shared :])
            table = minhash.sketch(np.concatenate((a, b)), np.array([0, n, 2 * n]), 480, minhash.donor_orders(480))
            total += (table[0] == table[1]).mean()
        assert abs(total / 30 - shared / (2 * n - shared)) < 0.05


def test_components_of_a_long_chain_and_a_star(spark):
    pick = random.Random(2)
    names = pick.sample(range(10_000), 300)
    links = list(zip(names, names[1:])) + [(20_000, 20_000 + i) for i in range(1, 200)] + [(7, 7)]
    got = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"), "c").collect()
    low = {r.id: r.comp for r in got}
    assert all(low[k] == min(names) for k in names) and all(low[20_000 + i] == 20_000 for i in range(200))


def test_suffix_array():
    pick = random.Random(3)
    for _ in range(500):
        s = [pick.randrange(pick.choice([1, 2, 4])) for _ in range(pick.randrange(30))]
        assert suffix_array(np.array(s, int)) == sorted(range(len(s)), key=lambda i: s[i:])


def without(rows, length):
    """Per distinct (id, mark): removed bytes, spans, what is left."""
    seen, out = set(), {}
    for r in sorted({(r.id, r.mark, r.text) for r in rows}):
        b = r[2].encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        out[r[:2]] = (sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("sizes", [{}, {"share": 2, "block": 500}])
def test_repeats(documents, sizes):
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.coalesce("doc_id", F.lit(repeats.NO_ID)).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text")).collect()
    want = {k: v for k, v in without(rows, 100).items() if v[0]}
    got = {(r.id, r.mark): (r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.without_repeats(documents, 100, False, **sizes).collect()}
    assert got == want


def test_repeats_leave_whole_characters(documents):
    for r in repeats.without_repeats(documents, 100).collect():
        bytes(r.kept).decode()


def test_repeats_empty(nothing):
    assert repeats.without_repeats(nothing).collect() == []


def test_op5(spark, folder, rows):
    got = QUERIES["op5_suffix_dedup"](spark, folder).collect()
    assert len(got) == len(rows)
    assert all(r.n_bytes == len((t.text or "").encode()) for r in got for t in rows if t.doc_id == r.doc_id != 5)
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.kept_sha256 == empty for r in got if r.doc_id in (101, 102, 111, 400, 401))


def test_op10(spark, folder, rows):
    got = QUERIES["op10_minhash_dedup"](spark, folder).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id is not None and 100 <= r.doc_id < 300} == {100}
