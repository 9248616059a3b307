"""Readers and writers, the pipelines over files, and the streaming run."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from wordloom.operators import ontology as ON
from wordloom.plans import pipelines as PL
from wordloom.sources import files as S
from wordloom.streaming import tokenize_stream


def lines(folder):
    return [line for p in sorted(folder.glob("part-*")) for line in p.read_text("utf8").splitlines()]


@pytest.fixture
def corpus_csv(tmp_path):
    rows = [
        (0, ["1 cup brown sugar", ""], ["Mix brown sugar, and \"olive\" oil.", "Heat olive oil\nslowly."], "x.org/1"),
        (1, ["olive oil"], ["Heat olive oil.", "Add brown sugar."], "www.cookbooks.com/2"),
        (2, ["brown sugar"], ["Add olive oil to brown sugar."], "y.org"),
        (3, ["code"], ["var x"], "z.org"),
    ]
    path = tmp_path / "corpus.csv"
    quote = lambda t: '"' + t.replace('"', '""') + '"'
    text = ",title,ingredients,directions,link,source,NER\n"
    for i, a, b, link in rows:
        text += f"{i},t,{quote(json.dumps(a))},{quote(json.dumps(b))},{link},s,[]\n"
    path.write_text(text, "utf8")
    return str(path)


def test_corpus_to_documents(spark, tmp_path, corpus_csv):
    (tmp_path / "bad.txt").write_text("3 # contains code\n77 # other\n")
    bad = S.read_exclusions(spark, str(tmp_path / "bad.txt"))
    assert [tuple(r) for r in bad.collect()] == [(3, "contains code"), (77, "other")]
    docs = PL.prepare_corpus(S.read_corpus(spark, corpus_csv), bad).orderBy("doc_id").collect()
    assert [r.doc_id for r in docs] == [0, 2]
    assert docs[0].instructions == ['Mix brown sugar, and "olive" oil.', "Heat olive oil\nslowly."]
    (tmp_path / "worse.txt").write_text("3 no comment\n")
    with pytest.raises(Exception, match="not an exclusion line"):
        S.read_exclusions(spark, str(tmp_path / "worse.txt")).collect()


def test_pipelines(spark, tmp_path, corpus_csv):
    docs = PL.prepare_corpus(S.read_corpus(spark, corpus_csv))
    model = PL.build_bigrams(docs, 2)
    assert ("oliv", "oil") in {(r.w1, r.w2) for r in model.collect()}
    S.write_bigrams(model, str(tmp_path / "bigrams"))
    again = S.read_bigrams(spark, str(tmp_path / "bigrams"))
    assert [tuple(r) for r in again.collect()] == [
        tuple(r)[:2] for r in model.orderBy(F.desc("freq"), "w1", "w2").collect()
    ]
    training = PL.build_training_corpus(docs, again)
    S.write_training_text(training, str(tmp_path / "training"))
    text = lines(tmp_path / "training")
    assert len(text) == 6 and sum("oliv_oil" in t for t in text) >= 2
    back = S.read_training_text(spark, str(tmp_path / "training"))
    assert sorted(" ".join(r.tokens) for r in back.collect()) == sorted(text)
    result = PL.train_embeddings(back, dim=3, iterations=2, min_count=1, components=1)
    S.write_vectors(result.vectors, str(tmp_path / "vectors"), compression="gzip")
    parts = sorted((tmp_path / "vectors").glob("part-*.txt.gz"))
    first = next(t for p in parts for t in gzip.open(p, "rt", encoding="utf8").read().splitlines())
    assert first == f"{result.vocab.count()} 3"
    vectors = S.read_vectors(spark, str(tmp_path / "vectors"))
    one = {r.token: r.vec for r in vectors.collect()}
    two = {r.token: r.vec for r in result.vectors.collect()}
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], rel=1e-6) for k in one)
    with pytest.raises(Exception, match="(?i)exist"):
        S.write_vectors(result.vectors, str(tmp_path / "vectors"))
    S.write_vocabulary(result.vocab, str(tmp_path / "vocab"))
    counts = [int(line.split(" ")[1]) for line in lines(tmp_path / "vocab")]
    assert counts == sorted(counts, reverse=True) and len(counts) == len(two)
    assert S.save_stage(result.pairs, str(tmp_path / "pairs")).count() == result.pairs.count()


def test_wordlist(spark, tmp_path):
    (tmp_path / "w.json").write_text('[\n "cups",\n "cup",\n "leaves"\n]')
    path = str(tmp_path / "w.json")
    assert sorted(r.word for r in S.read_wordlist(spark, path).collect()) == ["cup", "leav"]
    assert [r.word for r in S.read_wordlist(spark, path, stemmed=False).collect()] == ["cups", "cup", "leaves"]


OWL = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="r" xmlns:rdfs="s" xmlns:owl="o">
 <owl:Ontology rdf:about="http://x/onto"/>
 <owl:Class rdf:about="http://x/A"><rdfs:label xml:lang="en"> food material </rdfs:label></owl:Class>
 <owl:Class rdf:about="http://x/B"><rdfs:subClassOf rdf:resource="http://x/A"/>
  <rdfs:label>nut food product</rdfs:label><rdfs:label>second</rdfs:label></owl:Class>
 <owl:Class rdf:about="http://x/C"><rdfs:subClassOf rdf:resource="http://x/B"/>
  <rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="p"/></owl:Restriction></rdfs:subClassOf>
 </owl:Class>
</rdf:RDF>"""


def test_ontology_file(spark, tmp_path):
    (tmp_path / "o.owl").write_text(OWL)
    nodes, edges = S.read_ontology(spark, str(tmp_path / "o.owl"))
    assert {r.id: r.label for r in nodes.collect()} == {
        "http://x/A": "food material", "http://x/B": "nut food product", "http://x/C": "C",
    }
    paths = ON.leaf_paths(nodes, edges)
    assert [r.path for r in paths.collect()] == [["food material", "nut food product", "C"]]
    S.write_leaf_paths(paths, str(tmp_path / "paths"))
    assert lines(tmp_path / "paths") == ["food material,nut food product,C"]


def test_stream_gives_the_batch_result(spark, tmp_path):
    batch = spark.createDataFrame(
        [(1, ["2 cups Flour"], ["Mix the flour."]), (2, [], ["Bake &amp; cool slowly!"])],
        "doc_id int, ingredients array<string>, instructions array<string>",
    )
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = (
        tokenize_stream(stream).writeStream.format("memory").queryName("tokens")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    got = sorted(spark.table("tokens").collect())
    assert got == sorted(tokenize_stream(batch).collect())
