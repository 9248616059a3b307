"""The parity-sketch join against brute force, and its bounds on random sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import parity
from llm.queries import QUERIES
from test_dedup import brute


def random_sets(pick, n, size):
    """Pairs of sets of about the least similarity that links, as sorted hashes."""
    for _ in range(n):
        a = {pick.getrandbits(64) for _ in range(size)}
        b = set(pick.sample(sorted(a), max(1, size - pick.randrange(size // 8 + 2)))) | {pick.getrandbits(64) for _ in range(pick.randrange(size // 8 + 2))}
        yield a, b


@pytest.mark.parametrize("percent", [85, 60])
def test_similar_sets_share_a_key_and_pass_the_screen(percent):
    pick, bands = random.Random(percent), parity.Bands(percent)
    met = linked = 0
    for size in (2, 5, 7, 8, 12, 20, 33, 60, 100, 250, 700, 3000):
        for pair in random_sets(pick, 60, size):
            sets = [np.array(sorted(s), np.uint64) for s in pair]
            inter, union = len(pair[0] & pair[1]), len(pair[0] | pair[1])
            both = [np.concatenate(sets), np.array([0, len(sets[0]), union + inter])]
            bits, at = parity.sketches(*both)
            rows = [bits[at[k] : at[k + 1]][None, :] for k in (0, 1)]
            width = min(r.shape[1] for r in rows)
            gap = int(np.bitwise_count(parity.fold(rows[0], width) ^ parity.fold(rows[1], width)).sum())
            assert gap <= union - inter
            if 100 * inter < percent * union:
                continue
            linked += 1
            assert parity.may_link(len(sets[0]), len(sets[1]), gap, percent)
            keys = []
            for s in sets:
                low, high = bands.of(np.array([len(s)]))
                own = [parity.block_keys(s, np.array([0, len(s)]), np.array([b]), bands)[0] for b in range(low[0], high[0] + 1) if bands.bound[b]]
                keys.append(set(np.concatenate([*own, np.zeros(0, np.uint64)]).tolist()))
            met += bool(keys[0] & keys[1]) or pair[0] == pair[1]
    assert met == linked > 100


def test_components(documents, rows, percent=80):
    unique = [r for r in rows if not (r.doc_id == 5 and rows.index(r) > [x.doc_id for x in rows].index(5))]
    docs = documents.sparkSession.createDataFrame(unique, documents.schema)
    got = sorted(map(tuple, parity.similarity_components(docs, percent, width=5).collect()), key=str)
    sets, low = brute(unique, percent)
    assert got == sorted([(k, len(s), low[k]) for k, s in sets], key=str)


def test_op12_with_repeated_ids(spark, folder):
    got = QUERIES["op12_parity_join"](spark, folder).collect()
    ids = {r.doc_id: r.component_id for r in got}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(ids[100 + i] == 100 for i in range(12)) and all(ids[200 + i] == 100 for i in range(12)) and ids[404] == ids[405] == 404
    assert ids[None] is None


def test_families_of_one_template(spark, monkeypatch):
    """Texts that share most of their blocks but link only in some pairs, compared in several tiles."""
    monkeypatch.setattr(parity, "TILE", 16)
    monkeypatch.setattr(parity, "SMALL", 9)
    pick = random.Random(4)
    head, tail = ([f"{c}{i}" for i in range(30)] for c in "ht")
    rows = []
    for i in range(150):
        own = [f"o{pick.randrange(12)}" for _ in range(3)]
        rows.append((1000 - i, " ".join([*head, own[0], *tail[:15], own[1], *tail[15:], own[2], "end"])))
    rows += [(2000 + i, " ".join(f"v{k}" for k in range(i * 4, i * 4 + 70))) for i in range(30)]  # a chain
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, parity.similarity_components(docs, 85, width=4, rounds=1).collect()))
    sets, low = four_word_components(rows, 85)
    assert got == sorted((k, len(s), low[k]) for k, s in sets)
    assert 3 < len({c for _, _, c in got}) < 150


@pytest.mark.parametrize("lot", [parity.LOT, 8])
def test_sets_that_share_a_passage_make_no_pairs(spark, monkeypatch, lot):
    """Texts with a passage in common agree in blocks; only those that may link are paired, whatever the size of the bucket."""
    seen, screen, hopeful = [], parity.screen, parity.hopeful
    monkeypatch.setattr(parity, "LOT", lot)
    monkeypatch.setattr(parity, "screen", lambda pairs, *more: seen.append(pairs.count()) or screen(pairs, *more))
    monkeypatch.setattr(parity, "hopeful", lambda shared, *more: hopeful(shared, *more) if seen.append(shared.count()) is None else None)
    passage = [f"p{i}" for i in range(80)]
    # Long and short ones: sketches of several widths.
    rows = [(i, " ".join([f"a{i}x{k}" for k in range(120 if i % 3 else 700)] + passage)) for i in range(30)]
    rows += [(100 + i, f"{rows[i][1]} more") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, parity.similarity_components(docs, 85, width=4).collect()))
    sets, low = four_word_components(rows, 85)
    assert got == sorted((k, len(s), low[k]) for k, s in sets) and low[102] == 2
    shared, first, *_ = seen
    assert shared > 60 and (first < 12 or lot == 8)


def four_word_components(rows, percent, width=4):
    sets = [(k, {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}) for k, w in ((k, t.split()) for k, t in rows)]
    low = {k: k for k, _ in sets}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if low[a] != low[b] and 100 * len(x & y) >= percent * len(x | y):
                small, both = min(low[a], low[b]), (low[a], low[b])
                low = {k: small if v in both else v for k, v in low.items()}
    return sets, low


def test_nothing_and_clashing_columns(spark, nothing):
    assert parity.similarity_components(nothing).collect() == []
    rows = spark.range(3).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(1).alias("n_shingles"), F.lit(1).alias("comp"))
    assert sorted(map(tuple, parity.similarity_components(rows).collect())) == [(i, 0, i) for i in range(3)]
