"""The pipeline, stage by stage, against plain Python."""

from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline as P
from __spark_entry__ import oracle_sql, queries
from llm import rules

from test_dedup import shingles, without


def test_registered():
    assert {"pipeline", *(f"op{n}" for n in range(1, 14))} <= {k.split("_")[0] for k in queries()}
    assert set(oracle_sql()) <= set(queries())


def test_stages(spark, folder, documents):
    docs = documents.withColumns({"n_words": documents.doc_id}).select(*documents.columns, "n_words")
    kept = P.quality_rules(spark, docs, folder)
    first = kept.collect()
    strict = {r.doc_id for r in rules.ledger(documents.select("doc_id", "text")).where(rules.passes(rules.STRICT)).collect()}
    assert {r.doc_id for r in first} == strict and 400 not in strict and 100 in strict

    near = P.near_duplicates(spark, kept, folder)
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    second = near.withColumn("mark", mark).collect()
    ids = [r.doc_id for r in second]
    # Id 5 has two different texts, which are documents of their own.
    assert len(ids) == len(set(ids)) + 1 and ids.count(5) == 2 and 100 in ids and not {101, 111, 200, 211} & set(ids)
    sets = [shingles(r.text) for r in second]
    assert not any(100 * len(x & y) >= 80 * len(x | y) for k, x in enumerate(sets) for y in sets[:k] if x)

    cut = P.repeated_strings(spark, near, folder)
    third = cut.collect()
    assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in third)

    class Row:
        def __init__(self, r):
            self.id, self.mark, self.text = -1 if r.doc_id is None else r.doc_id, r.mark, r.text or ""

    for (k, _), (_, _, left) in without([Row(r) for r in second], 100).items():
        texts = [r.text or "" for r in third if r.doc_id == (None if k == -1 else k)]
        try:
            assert left.decode() in texts
        except UnicodeDecodeError:
            assert any(len(t.encode()) >= len(left) for t in texts)

    clean = P.decontamination(spark, cut, folder)
    assert 3 not in {r.doc_id for r in clean.collect()} and clean.columns == list(P.COLUMNS)
    mixed = P.mixing(spark, clean, folder)
    assert mixed.count() == clean.count() and set(P.COLUMNS) < set(mixed.columns)


def test_near_duplicates_shuffle_no_text(spark, folder, documents):
    """What goes is told to all tasks, also above the size to which Spark itself broadcasts; both ways give the same rows."""
    docs, found = documents.select(*P.COLUMNS), []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = P.minhash.BROADCAST
    try:
        for most in (before, 0):
            P.minhash.BROADCAST = most
            out = P.near_duplicates(spark, docs, folder)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert ("Exchange hashpartitioning" in plan) == (most == 0)
            found.append(sorted(map(str, out.collect())))
    finally:
        P.minhash.BROADCAST = before
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found[0] == found[1] and 0 < len(found[0]) < docs.count()


def test_near_duplicates_of_null_and_repeated_ids(spark):
    """Ids do not join rows of different texts, and no row goes without a near copy that stays."""
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdefg"}
    near = text["d"] + " more"
    rows = [
        (3, text["a"]), (7, text["a"]), (7, text["b"]), (None, text["c"]), (None, text["d"]), (None, text["e"]), (None, text["e"]),
        (9, near), (5, text["f"]), (5, text["g"]), (8, text["g"]), (8, text["g"]), (10, None), (10, None), (10, ""), (11, None),
    ]
    docs = spark.createDataFrame([(*r, "en", "s0", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = [
        (3, text["a"]), (7, text["b"]), (None, text["c"]), (None, text["d"]), (None, text["e"]), (5, text["f"]), (5, text["g"]),
        (10, None), (10, ""), (11, None),
    ]
    for parts in (1, 5):
        got = P.near_duplicates(spark, docs.repartition(parts), "").select("doc_id", "text").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_run_on_an_empty_table(spark, nothing):
    docs = nothing
    for _, stage in P.STAGES[:3]:
        docs = stage(spark, docs, "")
    assert docs.count() == 0 and P.mixing(spark, docs, "").count() == 0


def test_run(spark, folder):
    out = P.run(spark, folder).collect()
    assert out and all(r.taken == r.copies * r.size for r in out)


def test_stages_delete_the_tables_of_earlier_ones(spark, documents, folder, tmp_path):
    near = P.near_duplicates(spark, documents, folder)
    made = {s.folder for s in P._MADE["near_duplicates"]}
    there = lambda f: Path(f.removeprefix("file:")).exists()
    P.repeated_strings(spark, near, folder)  # reads them still
    assert made and any(map(there, made))
    near.write.parquet(f"{tmp_path}/near")
    P.decontamination(spark, spark.read.parquet(f"{tmp_path}/near"), folder)
    assert not any(map(there, made)) and P._MADE["near_duplicates"] == []
