"""Documents, bigrams, vocabulary and co-occurrence against brute force."""

import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import queries as Q
from wordloom import runtime
from wordloom.operators import bigrams as B
from wordloom.operators import cooccur as CO
from wordloom.operators import corpus as D
from wordloom.operators import lookup, packed
from wordloom.runtime import most_frequent, number_rows

PAIR = "array<struct<token:string,pos:string>>"


def greedy(tokens, model):
    out, i = [], 0
    while i < len(tokens):
        if i + 1 < len(tokens) and (tokens[i], tokens[i + 1]) in model:
            out.append(f"{tokens[i]}_{tokens[i + 1]}")
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return [t for t in out if t is not None]


@pytest.fixture(scope="module")
def random_tokens():
    rng = random.Random(5)
    rows = [[rng.choice(["a", "b", "c", None]) for _ in range(rng.randrange(0, 14))] for _ in range(300)]
    return [*rows, ["a", "b", "a", "b", "a"], [], ["a"], ["a", None, "b"]]


@pytest.mark.parametrize("max_rows", [100, 1])
def test_join_bigrams_is_greedy(spark, random_tokens, max_rows):
    model = {("a", "b"), ("b", "a"), ("c", "c"), ("b", "c")}
    pairs = spark.createDataFrame(sorted(model), "w1 string, w2 string")
    df = spark.createDataFrame(list(enumerate([*random_tokens, None])), "i int, tokens array<string>")
    joined = B.join_bigrams(df, pairs, max_rows=max_rows).withColumn("tokens", F.array_compact("tokens"))
    got = {r.i: r.tokens for r in joined.collect()}
    assert got == {**{i: greedy(t, model) for i, t in enumerate(random_tokens)}, len(random_tokens): None}


def test_bigram_counts_and_threshold(spark):
    def s(*words):
        return [None if w is None else (w, {"v": "VB", "j": "JJ"}.get(w[0], "NN")) for w in words]

    body = s("jam", "nut", None, "nut", "oil", "oil", "jam", "vet", "nut", "cup", "nut", "oil")
    df = spark.createDataFrame([(1, body), (2, s("nut", "oil")), (3, [])], f"doc_id int, body {PAIR}")
    got = {(r.w1, r.w2): r.freq for r in B.extract_bigrams(df, 1, ["body"], ["cup"]).collect()}
    # "jam" is tagged JJ, so it may only come first
    assert got == {("jam", "nut"): 1, ("nut", "oil"): 3}
    assert B.extract_bigrams(df, 2, ["body"], ["cup"]).count() == 1
    assert B.extract_bigrams(df, 0.51, ["body"], ["cup"]).count() == 1
    assert B.extract_bigrams(df, 0.2, ["body"], ["cup"]).count() == 2


def test_corpus_with_bigrams_gives_both_versions(spark):
    df = spark.createDataFrame(
        [(1, [("x", "NN"), None, ("a", "NN")], [("b", "NN"), ("c", "NN"), None])],
        f"doc_id int, ingredients {PAIR}, instructions {PAIR}",
    )
    model = spark.createDataFrame([("b", "c"), ("a", "b")], "w1 string, w2 string")
    streams = df.withColumn("ingredients", F.concat("ingredients", F.array(F.lit(None).cast("struct<token:string,pos:string>"))))
    rows = B.corpus_with_bigrams(streams, model).orderBy("joined").collect()
    assert [(r.joined, r.tokens) for r in rows] == [(False, ["x", "a", "b", "c"]), (True, ["x", "a", "b_c"])]
    assert [r.tokens for r in B.corpus_with_bigrams(streams).collect()] == [["x", "a", "b", "c"]]


def test_tokenize_documents(spark):
    df = spark.createDataFrame(
        [(1, ["2 cups all-purpose Flour", "", "!!"], ["Mix the flour and sugars.", "Bake because ovens."])],
        "doc_id int, ingredients array<string>, instructions array<string>",
    )
    docs = D.clean_documents(df)
    row = D.tokenize_documents(docs).first()
    words = [[x and x.token for x in s] for s in (row.ingredients, row.instructions)]
    assert words[0] == ["cup", None, "purpos", "flour", None]
    # "because" differs from its stem, which is in the list, so it is not removed as a stop word
    assert words[1][:6] == ["mix", None, "flour", None, "sugar", None]
    streams = D.token_streams(D.filter_tokens(D.split_tokens(docs), stop_words=[]))
    some = spark.createDataFrame([("flour", "FL"), ("mix", "MX")], "token string, stem string")
    row = D.stem_streams(streams, stems=some).first()
    assert [x.token for x in row.instructions if x][:3] == ["MX", "FL", "sugar"]
    flat = D.flatten_documents(D.tokenize_documents(docs)).first().tokens
    assert flat[:4] == ["cup", "purpos", "flour", "mix"] and None not in flat


def brute_pairs(docs, ids, window, symmetric, weighted):
    x = Counter()
    for doc in docs:
        known = [ids[t] for t in doc if t in ids]
        for j, target in enumerate(known):
            for i in range(max(0, j - window), j):
                w = 1 / (j - i) if weighted else 1.0
                x[target, known[i]] += w
                if symmetric:
                    x[known[i], target] += w
    return x


@pytest.mark.parametrize("symmetric", [True, False])
@pytest.mark.parametrize("weighted", [True, False])
@pytest.mark.parametrize("max_rows", [100, 1])
def test_cooccurrence(spark, symmetric, weighted, max_rows, monkeypatch):
    monkeypatch.setattr(CO, "BLOCK", 7)
    rng = random.Random(1)
    docs = [[rng.choice("abcdefgh") for _ in range(rng.randrange(0, 60))] for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id int, tokens array<string>")
    vocab = CO.vocabulary(df, min_count=130)
    ids = {r.word: r.word_id for r in vocab.collect()}
    assert 0 < len(ids) < 8
    encoded = CO.encode_documents(df, vocab, max_rows)
    pairs = CO.cooccurrence(encoded.repartition(3), 5, symmetric, weighted)
    got = {(r.wi, r.wj): r.x for r in pairs.collect()}
    assert got == pytest.approx(brute_pairs(docs, ids, 5, symmetric, weighted))


def test_cooccurrence_shuffles_sums_only(spark):
    """Pairs are summed before the shuffle, in numpy; null documents and ids beyond 32 bits are kept apart."""
    rows = [(1, [0, 1 << 40, 0, 7] * 700), (2, None), (3, []), (4, [7])]
    df = spark.createDataFrame(rows, "doc_id int, ids array<bigint>").coalesce(1)
    pairs = CO.cooccurrence(df, 3, symmetric=False)
    assert "MapInArrow" in pairs._jdf.queryExecution().executedPlan().toString()
    want = Counter()
    for i, target in enumerate(rows[0][1]):
        for k in range(1, min(3, i) + 1):
            want[target, rows[0][1][i - k]] += 6 // k
    assert {(r.wi, r.wj): round(r.x * 6) for r in pairs.collect()} == want


def test_large_lookup_asks_for_the_words_of_a_chunk_once(spark, monkeypatch):
    """No row per element is shuffled; null arrays, null elements, unknown words, equal rows and other columns are kept."""
    monkeypatch.setattr(lookup, "CHUNK_BITS", 1)
    rows = [(None, ["a", "b", "a", None, "x"], 1.5), (1, None, 2.5), (1, [], None), (2, ["c"] * 50, 0.0), (2, ["c"] * 50, 0.0)]
    df = spark.createDataFrame(rows, "doc_id int, words array<string>, v double").coalesce(1)
    table = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "key string, value int")
    found = lookup.match_elements(df, F.col("words"), table, "found", max_rows=2)
    assert "CoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    ids = {"a": 1, "b": 2, "c": 3}
    want = [(*r, None if r[1] is None else [ids.get(w) for w in r[1]]) for r in rows]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_each_distinct_string_of_a_chunk_is_worked_out_once(spark, monkeypatch):
    rows = [(1, [["a", "b"], None, ["a", None]], ["b"]), (2, None, ["a", "c"]), (3, [[]], None), (4, [["c", "a"]], [])]
    df = spark.createDataFrame(rows, "id long, x array<array<string>>, y array<string>").coalesce(1)
    known = spark.createDataFrame([("b", "B"), ("c", None)], "key string, value string")
    for at_a_time in (1, 1000):
        monkeypatch.setattr(lookup, "STRINGS_AT_A_TIME", at_a_time)
        rule = lambda words: F.expr(f"transform({words}, w -> concat(w, w))")
        out = {r.id: (r.x, r.y) for r in lookup.each_distinct(df, ["x", "y"], rule, known=known).collect()}
        assert out == {
            1: ([["aa", "B"], None, ["aa", None]], ["B"]), 2: (None, ["aa", "cc"]), 3: ([[]], None), 4: ([["cc", "aa"]], [])
        }
    drawn = lookup.each_distinct(df, ["x", "y"], lambda words: F.expr(f"transform({words}, w -> concat(w, uuid()))"))
    flat = drawn.select(F.explode(F.concat(F.flatten(F.array_compact(F.coalesce("x", F.array()))), F.coalesce("y", F.array()))).alias("w"))
    assert flat.where("w IS NOT NULL").distinct().count() == 3


def test_tags_and_stems_are_worked_out_for_distinct_words(spark):
    df = spark.createDataFrame([(1, [["red", "apples"], ["red", "and"]]), (2, None)], "doc_id long, s array<array<string>>")
    kept = D.filter_tokens(df, ["s"])
    streams = D.token_streams(kept, ["s"])
    done = D.stem_streams(streams, ["s"])
    for before, after in ((df, kept), (streams, done)):
        plans = [x._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") for x in (before, after)]
        assert plans[1] == plans[0] + 2
    rows = {r.doc_id: r.s for r in done.collect()}
    assert rows[2] is None
    assert [x and x.token for x in rows[1]] == ["red", "appl", None, "red", None, None]


@pytest.mark.parametrize("rows", [[(["k"], [], ["pie"])], [([], [], ["pie"]), ([], None, [])], [([], [], [])], [(None, None, None)], []])
def test_arrays_without_elements_stay(spark, rows):
    df = spark.createDataFrame([(k, o, a and [a], b and [b]) for k, (o, a, b) in enumerate(rows)], "k int, o array<string>, a array<array<string>>, b array<array<string>>").coalesce(1)
    done = D.stem_streams(D.token_streams(D.filter_tokens(df, ["a", "b"]), ["a", "b"]), ["a", "b"])
    got = [(r.o, r.a and [x and x.token for x in r.a], r.b and [x and x.token for x in r.b]) for r in done.orderBy("k").collect()]
    assert got == [(o, a, b and ["pie", None]) for o, a, b in rows]


def test_bigram_counts_are_written_as_parquet(spark):
    pairs = [[("red", "JJ"), ("apple", "NN"), None, ("apple", "NN"), ("pie", "NN")]]
    model = B.extract_bigrams(spark.createDataFrame([(pairs[0],), (None,)], f"s {PAIR}"), 1, ["s"], [])
    assert sorted((r.w1, r.w2, r.freq) for r in model.collect()) == [("apple", "pie", 1), ("red", "apple", 1)]
    assert all(f.endswith(".parquet") for f in model.inputFiles()) and model.inputFiles()


def test_vocabulary_of_limited_size_sorts_few_words(spark, monkeypatch):
    words = [f"w{k}" for k in range(3000)]
    df = spark.createDataFrame([(words,), (["x", "x", "x", "y", "y"],)], "tokens array<string>")
    sorted_rows = []
    plain = CO.number_rows
    monkeypatch.setattr(CO, "number_rows", lambda rows, *more: (sorted_rows.append(rows.count()), plain(rows, *more))[1])
    hashed = dict((r.w, r.h) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.md5("w").alias("h")).collect())
    for n in (1, 2, 3, 500, 3001, 3002, 4000):
        sorted_rows.clear()
        first = ["x", "y", *sorted(words, key=hashed.get)][:n]
        got = {r.word: r.word_id for r in CO.vocabulary(df, max_vocab=n).collect()}
        assert set(got) == set(first) and sorted(got.values()) == list(range(len(first)))
        assert max(sorted_rows) <= n


def test_spread_grows_with_the_files(spark, tmp_path, monkeypatch):
    spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    cores = spark.sparkContext.defaultParallelism
    assert runtime.spread(df, "id").rdd.getNumPartitions() == cores
    monkeypatch.setattr(runtime, "SPREAD_BYTES", 40_000)
    wide = runtime.spread(df, "id")
    assert wide.rdd.getNumPartitions() >= 20 > cores and wide.count() == 20_000


def test_wide_window_uses_exact_decimals(spark):
    df = spark.createDataFrame([(1, list(range(40)))], "doc_id int, ids array<int>")
    got = {(r.wi, r.wj): r.x for r in CO.cooccurrence(df, 30).collect()}
    assert got[0, 29] == pytest.approx(1 / 29) and got[5, 4] == 1 and (0, 31) not in got


def test_vocabulary_order_and_size(spark):
    words = ["b"] * 3 + ["a"] * 3 + ["c"] * 5 + ["d", "e", "f", "g"]
    df = spark.createDataFrame([(1, words)], "doc_id int, tokens array<string>")
    rows = CO.vocabulary(df).collect()
    assert sorted((r.word_id, r.word, r.cnt) for r in rows)[:4] == [(0, "c", 5), (1, "a", 3), (2, "b", 3), (3, "d", 1)]
    top = sorted((r.word_id, r.word) for r in CO.vocabulary(df, max_vocab=4).collect())
    assert top[:3] == [(0, "c"), (1, "a"), (2, "b")] and len(top) == 4
    assert CO.vocabulary(df, min_count=3).count() == 3


def test_number_rows_and_most_frequent(spark):
    df = spark.range(1000).select("id", ((F.col("id") * 7919) % 1009).alias("k")).repartition(5)
    got = [r.n for r in number_rows(df, [F.col("k")], "n").orderBy("k").collect()]
    assert got == list(range(1000))
    counts = spark.createDataFrame([(i, c) for i, c in enumerate([100, 70, 9, 8, 1, 1, 1])], "i int, cnt long")
    assert sorted(r.i for r in most_frequent(counts, 5).collect()) == [0, 1, 2, 3]
    assert most_frequent(counts, 1).count() == 0


def test_shuffle_is_repeatable(spark):
    df = spark.createDataFrame([(i, j, 1.0) for i in range(9) for j in range(9)], "wi int, wj int, x double")
    order = lambda d, s: [(r.wi, r.wj) for r in CO.shuffle_pairs(d, s).orderBy("place").collect()]
    assert order(df, 1) == order(df.repartition(7), 1)
    assert order(df, 1) != order(df, 2)
    assert sorted(order(df, 2)) == [(i, j) for i in range(9) for j in range(9)]


def test_filters(spark):
    rows = spark.createDataFrame(
        [(1, '["a"]', "www.cookbooks.com/1"), (2, '["b", ""]', "x.org"), (3, "[]", "y.org")],
        "doc_id long, ingredients string, link string",
    )
    bad = spark.createDataFrame([(3,), (9,)], "doc_id long")
    left = D.decode_json_sections(D.exclude_ids(D.drop_by_source(rows), bad), ["ingredients"]).collect()
    assert [(r.doc_id, r.ingredients) for r in left] == [(2, ["b", ""])]
    broken = rows.withColumn("ingredients", F.lit("[oops"))
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        D.decode_json_sections(broken, ["ingredients"]).collect()
    assert D.decode_json_sections(broken, ["ingredients"], strict=False).first().ingredients is None


def test_counting_pairs_holds_few_copies():
    """The pairs that are met are held in one array that is worked on in place, and packed numbers come back as they were."""
    rng = np.random.default_rng(4)
    words, row = rng.integers(0, 100, 100_000) << 20, np.repeat(np.arange(100), 1000)
    at = np.tile(np.arange(1000), 100)
    tracemalloc.start()
    wi, wj, s = CO._counted(words, row, at, np.array([0, 6, 3, 2, 1, 1, 1, 1, 1], np.int32), False, 1 << 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * 8 * 8 * len(words)
    want = Counter()
    for k, weight in enumerate([6, 3, 2, 1, 1, 1, 1, 1], 1):
        for a, b in zip(words.reshape(100, -1)[:, k:].ravel().tolist(), words.reshape(100, -1)[:, :-k].ravel().tolist()):
            want[a, b] += weight
    assert dict(zip(zip(wi.tolist(), wj.tolist()), s.tolist())) == want
    for x in (wi, s, np.array([], np.int64), np.array([-5, 3, 1 << 50])):
        assert np.array_equal(packed.wide(packed.narrow(x)), x)
    assert np.array_equal(np.cumsum(packed.wide(packed.rising(wi))), wi)
    # Steps of ordered numbers are small, so their upper bytes are alike.
    assert len(zlib.compress(packed.rising(wi))) < len(zlib.compress(wi.astype(np.int32).tobytes())) / 2


def test_words_are_written_and_not_persisted(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"red wine {k % 2}") for k in range(40)], "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    docs = Q.encoded(spark, str(tmp_path))
    plans = [docs, Q.QUERIES["vocab"](spark, str(tmp_path))]
    assert docs.where("size(ids) >= 2").count() == 40
    assert not any("InMemoryTableScan" in df._jdf.queryExecution().executedPlan().toString() for df in plans)


def test_a_large_lookup_moves_its_words_once(spark, monkeypatch):
    """Words that are replaced by their numbers are not carried along beside them."""
    written, write = [], lookup.write_stage
    monkeypatch.setattr(lookup, "write_stage", lambda rows: written.append(rows.columns) or write(rows))
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "doc_id int, tokens array<string>")
    vocab = spark.createDataFrame([("a", 1), ("b", 2)], "word string, word_id int")
    assert sorted(map(tuple, CO.encode_documents(docs, vocab, max_rows=1).collect())) == [(1, [1, 2]), (2, [])]
    assert written == [["doc_id", "_keys", "_chunk"]]
