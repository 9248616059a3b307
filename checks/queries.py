"""The registered queries: each runs one operator, or a chain, over whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import oracle as O
from wordloom.functions import clean as C
from wordloom.functions import vectors as V
from wordloom.functions.stem import stem_vocabulary
from wordloom.functions.tagging import tag_word
from wordloom.functions.tokens import keep_token, tokenize
from wordloom.functions.wordlists import STOP_WORDS
from wordloom.operators import als as A
from wordloom.operators import bigrams as B
from wordloom.operators import cooccur as CO
from wordloom.operators import corpus as D
from wordloom.operators import denoise as DN
from wordloom.operators import glove as G
from wordloom.operators import ontology as ON
from wordloom.operators import retrofit as R
from wordloom.operators import strata as ST
from wordloom.plans import pipelines as PL
from wordloom.runtime import checkpoint, spread, table, write_stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BODY = ("body",)
SHARE = 0.0001


def register(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# --- the given tables in the shapes that the operators take --------------------------------


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """documents: one section, a line is a sentence"""
    return documents(spark, d).select("doc_id", F.split("text", "\n").alias("body"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    """conversations: each turn is a document, its section is given by the role, the other is NULL"""
    rows = table(spark, d, "conversations")
    lines = F.split("text", "\n")
    part = lambda ok: F.when(ok, lines)
    user = F.col("role") == "user"
    docs = rows.select(
        F.concat_ws(":", "conv_id", "turn").alias("doc_id"),
        part(user).alias("ingredients"),
        part(~user).alias("instructions"),
    )
    return spread(docs, "doc_id")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "pages"), "page_id")


def text_tokens(spark: SparkSession, d: str) -> DataFrame:
    """documents: all tokens of the whole text"""
    return documents(spark, d).select("doc_id", tokenize(C.clean_text(F.col("text"))).alias("tokens"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.col("vec_id").cast("string").alias("token"), F.col("embedding").alias("vec"), "label")


def vocab15(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    # Written once, as they are read twice: to count the words and to put numbers in their place.
    docs = write_stage(text_tokens(spark, d))
    return docs, CO.vocabulary(docs, min_count=15)


def encoded(spark: SparkSession, d: str) -> DataFrame:
    return CO.encode_documents(*vocab15(spark, d))


def long_vector(df: DataFrame, keys: list[str], vec: Column, digits: int) -> DataFrame:
    df = df.select(*keys, F.posexplode(vec).alias("i", "v"))
    return df.select(*keys, "i", (F.round("v", digits) + F.lit(0.0)).alias("v"))


# --- cleaning -------------------------------------------------------------------------------

_SOURCES = {
    "documents": ("doc_id", "text"),
    "pages": ("page_id", "html"),
}
_CLEANERS = {
    "unescape_html": (C.unescape_html, O.unescape, "pages"),
    "remove_html_tags": (C.remove_html_tags, O.html_tags, "pages"),
    "remove_urls": (C.remove_urls, O.urls, "pages"),
    "remove_currency": (C.remove_currency, O.currency, "documents"),
    "remove_numeric": (C.remove_numeric, O.numeric, "documents"),
    "remove_symbols": (C.remove_symbols, O.symbols, "documents"),
    "remove_quotes": (C.remove_quotes, O.quotes, "documents"),
    "split_ampersand": (C.split_ampersand, O.ampersand, "pages"),
    "collapse_whitespace": (C.collapse_whitespace, O.whitespace, "documents"),
    "remove_bad_words": (C.remove_bad_words, O.bad_words, "documents"),
    "clean_text": (C.clean_text, O.clean, "documents"),
    "clean_pages": (C.clean_text, O.clean, "pages"),
}


def _cleaner(name: str) -> None:
    function, sql, source = _CLEANERS[name]
    key, column = _SOURCES[source]

    @register(name, f"SELECT {key}, {sql(column)} AS text FROM {source}")
    def query(spark, d):
        rows = spread(table(spark, d, source).select(key, column), key)
        return rows.select(key, function(F.col(column)).alias("text"))


for _name in _CLEANERS:
    _cleaner(_name)


@register(
    "clean_urls",
    f"SELECT page_id, {O.urls("'see ' || url || ' for more, or ' || replace(url, 'http', ' ')")} AS text FROM pages",
)
def _(spark, d):
    u = F.col("url")
    text = F.concat(F.lit("see "), u, F.lit(" for more, or "), F.replace(u, F.lit("http"), F.lit(" ")))
    return pages(spark, d).select("page_id", C.remove_urls(text).alias("text"))


@register(
    "clean_sentences",
    f"""SELECT doc_id, coalesce(string_agg({O.clean('sentence')}, '|' ORDER BY sent) FILTER (sentence <> ''), '') AS text,
           count(*) FILTER (sentence <> '') AS n
    FROM ({O.DOCUMENT_SENTENCES}) GROUP BY doc_id""",
)
def _(spark, d):
    docs = D.clean_documents(sentences(spark, d), BODY)
    return docs.select("doc_id", F.array_join("body", "|").alias("text"), F.size("body").cast("long").alias("n"))


@register(
    "tokenize",
    f"SELECT doc_id, array_to_string({O.token_list(O.clean('text'))}, ' ') AS tokens FROM documents",
)
def _(spark, d):
    return text_tokens(spark, d).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


# --- filters --------------------------------------------------------------------------------


@register(
    "drop_by_source",
    """SELECT page_id, nullif(url, u) AS url FROM pages, (SELECT min(url) AS u FROM pages)
    WHERE NOT coalesce(contains(nullif(url, u), 'example.com'), false)""",
)
def _(spark, d):
    # One address is taken away: a row without a source stays.
    rows = table(spark, d, "pages")
    rows = rows.withColumn("url", F.nullif("url", F.lit(rows.agg(F.min("url")).first()[0])))
    return D.drop_by_source(rows, "example.com", "url").select("page_id", "url")


@register(
    "exclude_ids",
    "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def _(spark, d):
    bad = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return D.exclude_ids(table(spark, d, "documents").select("doc_id", "n_chars"), bad)


@register(
    "decode_json",
    f"SELECT doc_id, sent - 1 AS place, sentence FROM ({O.DOCUMENT_SENTENCES})",
)
def _(spark, d):
    raw = sentences(spark, d).select("doc_id", F.to_json("body").alias("body"))
    docs = D.decode_json_sections(raw, BODY)
    return docs.select("doc_id", F.posexplode("body").alias("place", "sentence"))


@register(
    "tag_tokens",
    f"WITH {O.words(O.DOCUMENT_SENTENCES)} SELECT word, tag, count(*) AS cnt FROM tok GROUP BY ALL",
)
def _(spark, d):
    docs = D.split_tokens(D.clean_documents(sentences(spark, d), BODY), BODY)
    rows = D.explode_words(docs, F.flatten("body"), "word").groupBy("word")
    counts = rows.agg(F.count(F.lit(1)).alias("cnt"))
    return counts.select("word", tag_word("word").alias("tag"), "cnt")


@register(
    "keep_tokens",
    f"""WITH {O.words(O.DOCUMENT_SENTENCES)},
    marked AS (SELECT *, {O.kept('word', 'tag')} AND word NOT IN ({O.qs(STOP_WORDS)}) AS ok FROM tok)
    SELECT doc_id, coalesce(string_agg(CASE WHEN ok THEN word || '/' || tag ELSE '-' END, ' ' ORDER BY sent, pos)
                            FILTER (word IS NOT NULL), '') AS tokens
    FROM documents LEFT JOIN marked USING (doc_id) GROUP BY doc_id""",
)
def _(spark, d):
    docs = D.split_tokens(D.clean_documents(sentences(spark, d), BODY), BODY)
    docs = D.filter_tokens(docs, BODY, STOP_WORDS)
    mark = lambda x: F.coalesce(F.concat(x["token"], F.lit("/"), x["pos"]), F.lit("-"))
    shown = docs.select("doc_id", F.transform(F.flatten("body"), mark).alias("x"))
    return shown.select("doc_id", F.array_join("x", " ").alias("tokens"))


@register(
    "surface_stop_words",
    f"""WITH {O.words(O.TURN_SENTENCES)}
    SELECT section, word, count(*) AS cnt FROM tok
    WHERE {O.kept('word', 'tag')} AND word NOT IN ({O.qs(STOP_WORDS)}) GROUP BY ALL""",
)
def _(spark, d):
    docs = D.split_tokens(D.clean_documents(turns(spark, d)))
    rows = [
        D.explode_words(docs, F.flatten(s), "word").withColumn("section", F.lit(s)) for s in D.SECTIONS
    ]
    counts = reduce(DataFrame.union, rows).groupBy("section", "word").agg(F.count(F.lit(1)).alias("cnt"))
    tagged = counts.withColumn("tag", tag_word("word"))
    return tagged.where(keep_token("word", "tag", STOP_WORDS)).drop("tag")


@register(
    "stem_vocabulary",
    f"WITH {O.TEXT_WORDS}, w AS (SELECT word AS token FROM text_words), {O.stems('w')}, "
    "n AS (SELECT token, count(*) AS cnt FROM w GROUP BY token) "
    "SELECT token, cnt, stem FROM stems JOIN n USING (token)",
)
def _(spark, d):
    return stem_vocabulary(D.explode_words(text_tokens(spark, d), F.col("tokens"), "token"))


@register(
    "stem_dictionary",
    f"""SELECT doc_id, array_to_string(list_transform({O.token_list(O.clean('text'))}, lambda t: reverse(t)), ' ') AS tokens
    FROM documents""",
)
def _(spark, d):
    # A dictionary with more words than may be looked up in place counts in full.  Tokens and dictionary are written
    # once, as they are read several times.
    docs = write_stage(text_tokens(spark, d))
    stems = D.explode_words(docs, F.col("tokens"), "token").distinct().select("token", F.reverse("token").alias("stem"))
    stems = write_stage(stems)
    streams = docs.select("doc_id", F.expr("transform(tokens, t -> named_struct('token', t, 'pos', 'NN'))").alias("body"))
    stemmed = D.flatten_documents(D.stem_streams(streams, BODY, stems, max_rows=100), BODY)
    return stemmed.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


# --- bigrams --------------------------------------------------------------------------------


@register(
    "flatten_documents",
    f"""WITH {O.streams(O.TURN_SENTENCES)}
    SELECT d.doc_id, coalesce(t.tokens, '') AS tokens
    FROM (SELECT conv_id || ':' || turn AS doc_id FROM conversations) d
    LEFT JOIN (SELECT doc_id, {O.LINE} AS tokens FROM stream WHERE token IS NOT NULL GROUP BY doc_id) t
    USING (doc_id)""",
)
def _(spark, d):
    flat = D.flatten_documents(PL.preprocess(turns(spark, d)))
    return flat.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@register(
    "bigram_counts",
    f"WITH {O.streams(O.DOCUMENT_SENTENCES)}, {O.bigrams('body', '0')} SELECT w1, w2, freq FROM counts",
)
def _(spark, d):
    return B.count_bigrams(B.bigram_candidates(PL.preprocess(sentences(spark, d), BODY), BODY))


@register(
    "extract_bigrams",
    f"WITH {O.streams(O.DOCUMENT_SENTENCES)}, {O.bigrams('body', O.SHARE.format(SHARE))} SELECT * FROM model",
)
def _(spark, d):
    return PL.build_bigrams(sentences(spark, d), SHARE, BODY)


@register(
    "extract_bigrams_absolute",
    f"WITH {O.streams(O.TURN_SENTENCES)}, {O.bigrams('instructions', '3')} SELECT * FROM model",
)
def _(spark, d):
    return PL.build_bigrams(turns(spark, d), 3)


@register(
    "join_bigrams",
    f"""WITH {O.streams(O.DOCUMENT_SENTENCES)}, {O.bigrams('body', O.SHARE.format(SHARE))}, {O.JOINED}
    SELECT doc_id, coalesce({O.LINE}, '') AS tokens
    FROM documents LEFT JOIN joined USING (doc_id) GROUP BY doc_id""",
)
def _(spark, d):
    streams = PL.preprocess(sentences(spark, d), BODY)
    model = B.extract_bigrams(streams, SHARE, BODY)
    docs = B.corpus_with_bigrams(streams, model, BODY, keep_plain=False)
    return docs.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@register(
    "corpus_with_bigrams",
    f"""WITH {O.streams(O.TURN_SENTENCES)}, {O.bigrams('instructions', '3')}, {O.JOINED},
    lines AS (
        SELECT doc_id, true AS joined, {O.LINE} AS tokens FROM joined GROUP BY doc_id
        UNION ALL
        SELECT doc_id, false, {O.LINE} FROM stream WHERE token IS NOT NULL GROUP BY doc_id),
    docs AS (SELECT conv_id || ':' || turn AS doc_id, unnest([true, false]) AS joined FROM conversations)
    SELECT doc_id, joined, coalesce(tokens, '') AS tokens FROM docs LEFT JOIN lines USING (doc_id, joined)""",
)
def _(spark, d):
    streams = PL.preprocess(turns(spark, d))
    docs = B.corpus_with_bigrams(streams, B.extract_bigrams(streams, 3))
    return docs.select("doc_id", "joined", F.array_join("tokens", " ").alias("tokens"))


# --- vocabulary and co-occurrence -------------------------------------------------------------


@register("vocab", f"WITH {O.VOCAB} SELECT word_id, word, cnt FROM vocab")
def _(spark, d):
    return CO.vocabulary(text_tokens(spark, d), min_count=15)


@register(
    "vocab_topk",
    f"""WITH {O.TEXT_WORDS},
    n AS (SELECT word, count(*) AS cnt FROM text_words GROUP BY word),
    top AS (SELECT * FROM n ORDER BY cnt DESC, md5(word) LIMIT 1000)
    SELECT row_number() OVER (ORDER BY cnt DESC, word) - 1 AS word_id, word, cnt FROM top""",
)
def _(spark, d):
    return CO.vocabulary(text_tokens(spark, d), max_vocab=1000)


@register(
    "encode_documents",
    f"""WITH {O.VOCAB}
    SELECT doc_id, coalesce(string_agg(word_id::VARCHAR, ' ' ORDER BY place), '') AS ids
    FROM documents LEFT JOIN ids USING (doc_id) GROUP BY doc_id""",
)
def _(spark, d):
    ids = F.transform("ids", lambda i: i.cast("string"))
    return encoded(spark, d).select("doc_id", F.array_join(ids, " ").alias("ids"))


_PAIRS = "SELECT wi, wj, round(x, 6) AS x FROM pairs"


def _pairs(spark, d, **options) -> DataFrame:
    return CO.cooccurrence(encoded(spark, d), window=10, **options)


@register("cooccurrence", f"WITH {O.cooccurrence(10, True, True)} {_PAIRS}")
def _(spark, d):
    return _pairs(spark, d).select("wi", "wj", F.round("x", 6).alias("x"))


@register("cooccurrence_left", f"WITH {O.cooccurrence(10, True, False)} {_PAIRS}")
def _(spark, d):
    return _pairs(spark, d, symmetric=False).select("wi", "wj", F.round("x", 6).alias("x"))


@register("cooccurrence_unweighted", f"WITH {O.cooccurrence(10, False, True)} {_PAIRS}")
def _(spark, d):
    return _pairs(spark, d, distance_weighting=False).select("wi", "wj", F.round("x", 6).alias("x"))


@register(
    "shuffle_pairs",
    f"""WITH {O.cooccurrence(10, True, False)}
    SELECT row_number() OVER (ORDER BY md5(wi || ',' || wj || ',7'), wi, wj) - 1 AS place, wi, wj,
           round(x, 6) AS x FROM pairs""",
)
def _(spark, d):
    shuffled = CO.shuffle_pairs(_pairs(spark, d, symmetric=False), seed=7)
    return shuffled.select("place", "wi", "wj", F.round("x", 6).alias("x"))


@register(
    "glove_weight",
    f"""WITH {O.cooccurrence(10, True, True)}
    SELECT wi, wj, round(least(1.0, pow(x / 100, 0.75)), 6) AS f FROM pairs""",
)
def _(spark, d):
    return _pairs(spark, d).select("wi", "wj", F.round(V.glove_weight(F.col("x")), 6).alias("f"))


# every word gets the given vector whose number is its own, counted around; its last element is the bias
_PARAMS = """params AS MATERIALIZED (
    SELECT word_id, list_transform(embedding, lambda y: CAST(y AS DOUBLE)) AS v
    FROM vocab JOIN embeddings ON vec_id = word_id % (SELECT count(*) FROM embeddings))"""


@register(
    "glove_loss",
    f"""WITH {O.cooccurrence(10, True, True)}, {_PARAMS},
    diffs AS (
        SELECT least(1.0, pow(x / 100, 0.75)) AS f,
               list_dot_product(w.v[1:63], c.v[1:63]) + w.v[64] + c.v[64] - ln(x) AS diff
        FROM pairs JOIN params w ON w.word_id = wi JOIN params c ON c.word_id = wj)
    SELECT count(*) AS n_pairs, round(sum(f * diff * diff), 2) AS loss FROM diffs""",
)
def _(spark, d):
    docs, vocab = vocab15(spark, d)
    given = vectors(spark, d)
    n = given.agg(F.count(F.lit(1))).scalar()
    numbered = vocab.select("word_id", (F.col("word_id") % n).alias("vec_id"))
    v = V.doubles(F.col("vec"))
    params = numbered.join(given, "vec_id").select("word_id", v.alias("vec"), v.alias("context_vec"))
    pairs = CO.cooccurrence(CO.encode_documents(docs, vocab), window=10)
    loss = G.glove_loss(pairs, params)
    return loss.select("n_pairs", F.round("loss", 2).alias("loss"))


@register("train_glove")
def _(spark, d):
    pairs = checkpoint(_pairs(spark, d))
    params = ST.train_glove(pairs, dim=300, iterations=100, seed=1)
    return params.select("word_id", V.combine(F.col("vec"), F.col("context_vec")).alias("vec"))


_ALS_COLUMNS = (("vec", 0, "value"), ("vec", 1, "bias"), ("context_vec", 0, "context_value"), ("context_vec", 1, "context_bias"))


@register("train_glove_als")
def _(spark, d):
    params = A.train_glove_als(write_stage(_pairs(spark, d)), dim=300, sweeps=10, seed=1)
    return params.select("word_id", V.combine(F.col("vec"), F.col("context_vec")).alias("vec"))


@register("als_one_dimension", f"WITH {O.cooccurrence(10, True, True)}, {O.als_sweeps(2, 0.1)}")
def _(spark, d):
    """Two sweeps in one dimension, whose normal equations SQL can solve, from given values."""
    docs, vocab = vocab15(spark, d)
    pairs = write_stage(CO.cooccurrence(CO.encode_documents(docs, vocab), window=10))
    first = F.array((F.col("word_id") * 37 % 101 - 50) / 100, F.lit(0.0))
    params = A.train_glove_als(pairs, dim=1, sweeps=2, ridge=0.1, start=vocab.select("word_id", first.alias("vec")))
    parts = [F.round(F.col(side)[k], 6).alias(name) for side, k, name in _ALS_COLUMNS]
    return params.select("word_id", *parts)


@register("build_embeddings")
def _(spark, d):
    model = PL.build_bigrams(turns(spark, d), 3)
    return PL.build_embeddings(turns(spark, d), model, dim=300, iterations=100, min_count=5, components=2).vectors


# --- vectors --------------------------------------------------------------------------------

_LONG = """SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i,
    CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"""


@register(
    "gram_matrix",
    f"""WITH e AS ({_LONG})
    SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(sum(a.v * b.v), 6) + 0.0 AS v
    FROM e a JOIN e b USING (vec_id) GROUP BY ALL""",
)
def _(spark, d):
    rows = DN.gram_matrix(vectors(spark, d)).select("i", F.posexplode("row").alias("j", "v"))
    return rows.select("i", "j", (F.round("v", 6) + F.lit(0.0)).alias("v"))


@register("denoise")
def _(spark, d):
    return DN.denoise(vectors(spark, d), 5).select("vec_id", "vec")


@register(
    "project_out",
    f"""WITH e AS ({_LONG}), p AS (SELECT vec_id, sum(v) / 8.0 AS k FROM e GROUP BY vec_id)
    SELECT vec_id, CAST(i AS INTEGER) AS i, round(v - 0.5 * k / 8.0, 5) + 0.0 AS v FROM e JOIN p USING (vec_id)""",
)
def _(spark, d):
    unit = F.array_repeat(F.lit(1 / 8.0), 64)
    return long_vector(vectors(spark, d), ["vec_id"], V.project_out(F.col("vec"), unit, 0.5), 5)


@register(
    "vector_mean",
    f"""WITH e AS ({_LONG})
    SELECT label, CAST(i AS INTEGER) AS i, round(avg(v), 6) + 0.0 AS v FROM e GROUP BY ALL""",
)
def _(spark, d):
    means = vectors(spark, d).groupBy("label").agg(V.vector_mean(F.col("vec")).alias("m"))
    return long_vector(means, ["label"], F.col("m"), 6)


@register(
    "vector_change",
    f"""WITH e AS ({_LONG}), m AS (SELECT label, i, avg(v) AS m FROM e GROUP BY ALL)
    SELECT vec_id, round(sqrt(sum((v - m) * (v - m))), 6) AS change FROM e JOIN m USING (label, i) GROUP BY vec_id""",
)
def _(spark, d):
    e = vectors(spark, d)
    means = e.groupBy("label").agg(V.vector_mean(F.col("vec")).alias("m"))
    change = V.norm(V.minus(V.doubles(F.col("vec")), F.col("m")))
    return e.join(means, "label").select("vec_id", F.round(change, 6).alias("change"))


@register(
    "combine_vectors",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda y: CAST(y AS DOUBLE)) AS a,
                         list_reverse(list_transform(embedding, lambda y: CAST(y AS DOUBLE))) AS b FROM embeddings),
    m AS (
        SELECT vec_id, 0 AS model, list_concat(a, b) AS v FROM e
        UNION ALL SELECT vec_id, 1, a[1:63] FROM e
        UNION ALL SELECT vec_id, 2, list_transform(list_zip(a[1:63], b[1:63]), lambda p: p[1] + p[2]) FROM e
        UNION ALL SELECT vec_id, 3, list_concat(a[1:63], b[1:63]) FROM e)
    SELECT vec_id, model, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS i, round(unnest(v), 5) + 0.0 AS v FROM m""",
)
def _(spark, d):
    v = V.doubles(F.col("vec"))
    models = F.array(
        *[F.struct(F.lit(m).alias("model"), V.combine(v, F.reverse(v), m).alias("out")) for m in range(4)]
    )
    rows = vectors(spark, d).select("vec_id", F.inline(models))
    return long_vector(rows, ["vec_id", "model"], F.col("out"), 5)


@register(
    "lookup_vectors",
    """SELECT vec_id, label FROM embeddings
    WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
def _(spark, d):
    asked = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("token"))
    return DN.lookup_vectors(vectors(spark, d), asked).select("vec_id", "label")


@register(
    "retrofit_groups",
    f"""WITH e AS ({_LONG}),
    s AS (SELECT label, i, sum(v) AS s, count(*) AS n FROM e GROUP BY ALL)
    SELECT vec_id, CAST(i AS INTEGER) AS i,
           round(CASE WHEN n = 1 THEN v ELSE (0.5 * v + 0.5 * s) / (0.5 + 0.5 * n) END, 4) + 0.0 AS v
    FROM e JOIN s USING (label, i)""",
)
def _(spark, d):
    e = vectors(spark, d).select("token", V.doubles(F.col("vec")).alias("vec"), "label")
    members = e.select(F.col("label").alias("grp"), "token")
    done = R.retrofit(e, R.sums_from_groups(members), convergence_threshold=1e-9)
    done = done.select(F.col("token").cast("long").alias("vec_id"), "vec")
    return long_vector(done, ["vec_id"], F.col("vec"), 4)


def _edges_sql(rounds: int) -> str:
    """Neighbours: the vectors with the next lower and the next higher number."""
    ctes = [f"q AS ({_LONG})", "r0 AS (SELECT vec_id, i, v FROM q)"]
    for k in range(rounds):
        ctes.append(
            f"""n{k} AS (
            SELECT vec_id, i, v,
                   coalesce(lag(v) OVER w, 0) + coalesce(lead(v) OVER w, 0) AS s,
                   CASE WHEN lag(v) OVER w IS NULL THEN 0 ELSE 1 END
                   + CASE WHEN lead(v) OVER w IS NULL THEN 0 ELSE 1 END AS n
            FROM r{k} WINDOW w AS (PARTITION BY i ORDER BY vec_id)),
        r{k + 1} AS MATERIALIZED (
            SELECT n.vec_id, n.i, CASE WHEN n = 0 THEN q.v ELSE (0.5 * q.v + 0.5 * s) / (0.5 + 0.5 * n) END AS v
            FROM n{k} n JOIN q USING (vec_id, i))"""
        )
    return (
        f"WITH {', '.join(ctes)} "
        f"SELECT vec_id, CAST(i AS INTEGER) AS i, round(v, 5) + 0.0 AS v FROM r{rounds}"
    )


@register("retrofit_edges", _edges_sql(3))
def _(spark, d):
    e = vectors(spark, d).select("vec_id", "token", V.doubles(F.col("vec")).alias("vec"))
    step = F.explode(F.array(F.lit(-1), F.lit(1)))
    edges = e.select("token", step.alias("s"), "vec_id").select(
        "token", (F.col("vec_id") + F.col("s")).cast("string").alias("neighbour")
    )
    done = R.retrofit(e.select("token", "vec"), edges, max_iterations=3, convergence_threshold=0.0)
    done = done.select(F.col("token").cast("long").alias("vec_id"), "vec")
    return long_vector(done, ["vec_id"], F.col("vec"), 5)


# --- ontology -------------------------------------------------------------------------------


def ontology(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """region > nation > supplier and customer, under one root; a region names a group"""
    root = spark.range(1).select(F.lit("world").alias("id"), F.lit("food material").alias("label"))
    nodes, edges = [root], []
    for name, p, parent in (
        ("region", "r", None),
        ("nation", "n", ("r", "n_regionkey")),
        ("supplier", "s", ("n", "s_nationkey")),
        ("customer", "c", ("n", "c_nationkey")),
    ):
        key = {"region": "regionkey", "nation": "nationkey", "supplier": "suppkey", "customer": "custkey"}[name]
        df = table(spark, d, name)
        ident = F.concat(F.lit(p), F.col(f"{p}_{key}"))
        label = F.col(f"{p}_name")
        label = F.concat(label, F.lit(" food product")) if p == "r" else label
        up = F.concat(F.lit(parent[0]), F.col(parent[1])) if parent else F.lit("world")
        nodes.append(df.select(ident.alias("id"), label.alias("label")))
        edges.append(df.select(ident.alias("child"), up.alias("parent")))
    return reduce(DataFrame.union, nodes), reduce(DataFrame.union, edges)


PRUNED = ("NATION_3", "NATION_7", "ASIA food product")
_SHOWN = "SELECT leaf_id, path FROM leaves"


@register("leaf_paths", f"{O.paths()} {_SHOWN}")
def _(spark, d):
    paths = ON.leaf_paths(*ontology(spark, d), pruned=())
    return paths.select("leaf_id", F.array_join("path", ">").alias("path"))


@register("pruned_paths", f"{O.paths(PRUNED)} {_SHOWN}")
def _(spark, d):
    paths = ON.leaf_paths(*ontology(spark, d), pruned=PRUNED)
    return paths.select("leaf_id", F.array_join("path", ">").alias("path"))


@register(
    "pad_paths",
    f"""{O.paths()}, p AS (SELECT leaf_id, string_split(path, '>') AS p FROM leaves)
    SELECT leaf_id, p[1] AS level_0, coalesce(p[2], '') AS level_1, coalesce(p[3], '') AS level_2,
           coalesce(p[4], '') AS level_3 FROM p""",
)
def _(spark, d):
    return ON.pad_paths(ON.leaf_paths(*ontology(spark, d), pruned=()))


@register(
    "ontology_groups",
    f"""{O.paths(PRUNED)}, p AS (SELECT string_split(path, '>') AS p FROM leaves)
    SELECT DISTINCT p[2] AS grp, p[-1] AS member FROM p WHERE ends_with(p[2], 'food product')""",
)
def _(spark, d):
    return ON.ontology_groups(ON.leaf_paths(*ontology(spark, d), pruned=PRUNED))


def labels_and_vocab(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """part: names and brands are labels of the group of their type; the names are the vocabulary"""
    part = table(spark, d, "part")
    label = F.concat_ws(" ", "p_name", F.lit("of the"), F.lower("p_brand"), F.lit("7 (!)"))
    groups = part.select(F.col("p_type").alias("grp"), label.alias("member"))
    names = part.select(F.explode(F.split("p_name", " ")).alias("token"))
    return groups, stem_vocabulary(names).select(F.col("stem").alias("token"))


_LABELS = f"""part_words AS (
    SELECT p_type AS grp, p_name, unnest({O.token_list("p_name || ' of the ' || lower(p_brand) || ' 7 (!)'")}) AS token
    FROM part),
names AS (SELECT unnest(string_split(p_name, ' ')) AS token FROM part),
both_words AS (SELECT token FROM part_words UNION SELECT token FROM names),
{O.stems('both_words')},
known AS (SELECT DISTINCT stem FROM stems JOIN names USING (token)),
members AS (
    SELECT DISTINCT grp, stem AS token FROM part_words JOIN stems USING (token)
    WHERE stem IN (SELECT stem FROM known) AND {O.plain('token')} AND token NOT IN ('of', 'the'))"""


@register(
    "label_tokens",
    f"""WITH {_LABELS}
    SELECT p.p_partkey, string_agg(s.stem, ' ' ORDER BY p.k) AS tokens
    FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token,
                 generate_subscripts(string_split(p_name, ' '), 1) AS k FROM part) p
    JOIN stems s USING (token) GROUP BY p.p_partkey""",
)
def _(spark, d):
    _, vocab = labels_and_vocab(spark, d)
    label = F.concat_ws(" ", "p_name", F.lit("of the"), F.lower("p_brand"), F.lit("7 (!)"))
    labels = table(spark, d, "part").select("p_partkey", label.alias("member"))
    return ON.label_tokens(labels, vocab).select("p_partkey", F.array_join("tokens", " ").alias("tokens"))


@register("group_tokens", f"WITH {_LABELS} SELECT grp, token FROM members")
def _(spark, d):
    return ON.group_tokens(*labels_and_vocab(spark, d))


@register(
    "group_tokens_bigrams",
    f"""WITH {_LABELS},
    joined AS (
        SELECT p_type AS grp, a.stem || '_' || b.stem AS token
        FROM (SELECT p_type, string_split(p_name, ' ') AS w FROM part)
        JOIN stems a ON a.token = w[1] JOIN stems b ON b.token = w[2])
    SELECT grp, token FROM members UNION SELECT grp, token FROM joined""",
)
def _(spark, d):
    groups, vocab = labels_and_vocab(spark, d)
    # the model: all names of two words
    names = F.split("p_name", " ")
    pairs = table(spark, d, "part").select(names[0].alias("w1"), names[1].alias("w2")).distinct()
    stems = stem_vocabulary(pairs.select(F.explode(F.array("w1", "w2")).alias("token")))
    for w in ("w1", "w2"):
        pairs = pairs.join(stems.select(F.col("token").alias(w), F.col("stem").alias(f"{w}_stem")), w)
    model = pairs.select(F.col("w1_stem").alias("w1"), F.col("w2_stem").alias("w2"))
    return ON.group_tokens(groups, vocab, model)


_SIMILAR = """alike AS (
    SELECT DISTINCT a.token, b.token AS neighbour FROM members a JOIN members b USING (grp) WHERE a.token <> b.token)"""


@register("similar_tokens", f"WITH {_LABELS}, {_SIMILAR} SELECT token, neighbour FROM alike")
def _(spark, d):
    members = ON.group_tokens(*labels_and_vocab(spark, d))
    return ON.similar_tokens(members, members.select("token").distinct())


# customers of the same nation (large groups) and customers who ordered the same part (small ones)
@register(
    "count_neighbours",
    """WITH members AS (
        SELECT DISTINCT o_custkey AS token, 'p' || l_partkey AS grp FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        UNION SELECT c_custkey, 'n' || c_nationkey FROM customer),
    pairs AS (SELECT DISTINCT a.token, b.token AS neighbour FROM members a JOIN members b USING (grp))
    SELECT token, count(*) - 1 AS n FROM pairs GROUP BY token""",
)
def _(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("token"))
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey"))
    by_part = orders.join(items, "k").select(F.concat(F.lit("p"), "l_partkey").alias("grp"), "token")
    by_nation = table(spark, d, "customer").select(
        F.concat(F.lit("n"), "c_nationkey").alias("grp"), F.col("c_custkey").alias("token")
    )
    return R.count_neighbours(by_part.unionByName(by_nation))
