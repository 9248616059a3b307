"""Rows, tokens and numbers that must not get lost."""

import json

import pytest
from pyspark.sql import functions as F

from wordloom.functions.clean import CLEANERS, collapse_whitespace
from wordloom.functions.tokens import keep_token
from wordloom.operators import bigrams as B
from wordloom.operators import corpus as D
from wordloom.operators import denoise as DN
from wordloom.operators import retrofit as R
from wordloom.plans import pipelines as PL
from wordloom.runtime import checkpoint, checkpoint_folder, release
from wordloom.sources import files as S


def test_rows_without_a_source_stay(spark):
    rows = spark.createDataFrame([(1, None), (2, "x"), (3, "www.cookbooks.com/1")], "doc_id long, link string")
    assert {r.doc_id for r in D.drop_by_source(rows).collect()} == {1, 2}


def test_a_null_section_keeps_the_other(spark):
    docs = spark.createDataFrame([(1, None, ["mix flour"]), (2, None, None)], "doc_id long, ingredients array<string>, instructions array<string>")
    got = {r.doc_id: r.tokens for r in PL.build_training_corpus(docs).collect()}
    assert got == {1: ["mix", "flour"], 2: []}
    model = spark.createDataFrame([("mix", "flour")], "w1 string, w2 string")
    got = {(r.doc_id, len(r.tokens)): r.tokens for r in PL.build_training_corpus(docs, model).collect()}
    assert got[1, 1] == ["mix_flour"] and got[1, 2] == ["mix", "flour"]
    assert D.flatten_documents(PL.preprocess(docs)).where("doc_id = 1").first().tokens == ["mix", "flour"]


@pytest.mark.parametrize("max_rows", [1, 100])
def test_a_user_dictionary_counts_in_full(spark, max_rows):
    stream = [[("flour", "NN"), None, ("mixing", "NN"), ("sugars", "NN")], [("mixing", "NN")], None]
    kind = "array<struct<token:string,pos:string>>"
    streams = spark.createDataFrame([(1, stream[0], stream[1]), (2, stream[2], stream[0])], f"doc_id int, ingredients {kind}, instructions {kind}")
    stems = spark.createDataFrame([("flour", "FL", 5), ("mixing", "MX", 1)], "token string, stem string, cnt long")
    got = {r.doc_id: r for r in D.stem_streams(streams, stems=stems, max_rows=max_rows).collect()}
    words = lambda s: s and [x and x.token for x in s]
    assert words(got[1].ingredients) == ["FL", None, "MX", "sugar"] and words(got[1].instructions) == ["MX"]
    assert words(got[2].ingredients) is None and words(got[2].instructions) == ["FL", None, "MX", "sugar"]


def test_vectors_of_unequal_length_are_an_error(spark):
    rows = [("a", [1.0, 2.0, 3.0]), ("b", [4.0])]
    for parts in (1, 2):
        vectors = spark.createDataFrame(rows, "token string, vec array<double>").repartition(parts, "token")
        with pytest.raises(Exception, match="same length|Dimensions mismatch"):
            DN.denoise(vectors, 1).collect()
    with pytest.raises(Exception, match="NULL"):
        DN.denoise(spark.createDataFrame([("a", [1.0, None])], "token string, vec array<double>"), 1).collect()


def test_zero_vectors_stay_zero(spark):
    vectors = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [0.0, 0.0])], "token string, vec array<double>")
    assert [r.vec for r in DN.denoise(vectors, 2).collect()] == [[0.0, 0.0]] * 2


def test_rounds_leave_no_checkpoints(spark):
    from pathlib import Path

    folder = Path(checkpoint_folder(spark).removeprefix("file:"))
    count = lambda: sum(1 for _ in folder.glob("rdd-*"))
    vectors = spark.createDataFrame([(f"w{k}", [float(k), 1.0]) for k in range(6)], "token string, vec array<double>")
    edges = spark.createDataFrame([(f"w{k}", f"w{(k + 1) % 6}") for k in range(6)], "token string, neighbour string")
    before = count()
    R.retrofit(vectors, edges, max_iterations=5, convergence_threshold=0.0).collect()
    assert count() - before <= 2
    last = checkpoint(spark.range(3))
    release(last)
    assert count() - before <= 2


def test_bigrams_are_counted_once(spark):
    docs = spark.createDataFrame([(k, ["x"], ["red onion", "red onion soup"]) for k in range(4)], "doc_id long, ingredients array<string>, instructions array<string>")
    model = B.extract_bigrams(PL.preprocess(docs), 0.1)
    plan = model._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and {(r.w1, r.w2, r.freq) for r in model.collect()} == {("red", "onion", 8), ("onion", "soup", 4)}


def test_a_corpus_file_is_split(spark, tmp_path):
    rows = "".join(f'{k},"{json.dumps(["salt"] * 30).replace(chr(34), chr(34) * 2)}","[]",x\n' for k in range(3000))
    (tmp_path / "c.csv").write_text(",ingredients,directions,link\n" + rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    try:
        raw = S.read_corpus(spark, str(tmp_path))
        assert raw.rdd.getNumPartitions() > 1 and raw.count() == 3000
        assert PL.prepare_corpus(raw).where(F.size("ingredients") == 30).count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_only_the_first_line_is_a_header(spark, tmp_path):
    (tmp_path / "v.txt").write_text("2 1\n7 5\n8 9\n")
    got = {r.token: list(r.vec) for r in S.read_vectors(spark, str(tmp_path)).collect()}
    assert got == {"7": [5.0], "8": [9.0]}
    assert S.read_vectors(spark, str(tmp_path), header=False).count() == 3


def test_cjk_numerals_are_numbers(spark):
    rows = spark.createDataFrame([("三十",), ("五",), ("日本",), ("三人",)], "t string")
    kept = {r.t for r in rows.where(keep_token("t", "'NN'", ())).collect()}
    assert kept == {"日本", "三人"}


def test_pipelines_take_the_users_lists(spark, tmp_path):
    docs = spark.createDataFrame([(k, ["RED onion"], ["red onion soup cup"]) for k in range(4)], "doc_id long, ingredients array<string>, instructions array<string>")
    (tmp_path / "stop.json").write_text(json.dumps(["soup"]))
    stop = S.read_wordlist(spark, str(tmp_path / "stop.json"))
    assert "soup" not in PL.build_training_corpus(docs, stop_words=stop).first().tokens
    assert "soup" in PL.build_training_corpus(docs, stop_words=["onion"]).first().tokens
    stems = spark.createDataFrame([("onion", "ONION")], "token string, stem string")
    assert "ONION" in PL.build_training_corpus(docs, stems=stems).first().tokens
    assert PL.build_training_corpus(docs, cleaners=CLEANERS[:-1] + (collapse_whitespace,)).count() == 4
    pairs = {(r.w1, r.w2) for r in PL.build_bigrams(docs, 1, excluded=["soup"]).collect()}
    assert ("red", "onion") in pairs and ("onion", "soup") not in pairs
    result = PL.build_embeddings(docs, stop_words=["soup"], stems=stems, dim=4, iterations=1, min_count=1, components=1)
    assert {"ONION", "red"} <= {r.token for r in result.vectors.collect()}


def test_retrofitted_embeddings_in_one_plan(spark):
    nodes = spark.createDataFrame([("r", "food material"), ("g", "plant food product"), ("a", "apple"), ("b", "berry")], "id string, label string")
    edges = spark.createDataFrame([("g", "r"), ("a", "g"), ("b", "g")], "child string, parent string")
    vectors = spark.createDataFrame([("appl", [1.0]), ("berri", [3.0]), ("x", [9.0])], "token string, vec array<double>")
    got = {r.token: r.vec[0] for r in PL.retrofit_embeddings(vectors, nodes, edges, max_iterations=50).collect()}
    assert got["x"] == 9.0 and 1.0 < got["appl"] < got["berri"] < 3.0
