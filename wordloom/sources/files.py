"""Readers and writers.

Writers never replace what they read: they fail when the target exists, unless another
`mode` is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions.stem import stem_vocabulary


def read_corpus(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """`(doc_id, ingredients, instructions, link)` from CSV with a header.

    The columns are found by name; the id column has no name.  Cells are JSON text, with
    doubled quotes.  JSON escapes its line breaks, so files are split; with `multi_line`
    other cells may hold line breaks, and then a file is one split.  An empty cell is NULL.
    """
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=multi_line, inferSchema=False)
    return raw.select(
        F.col("_c0").cast("long").alias("doc_id"),
        "ingredients",
        F.col("directions").alias("instructions"),
        "link",
    )


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """S3: `(doc_id, comment)` from lines `12345 # comment`; any other line is an error."""
    line = F.col("value")
    pattern = r"\A\s*([+-]?\d+)\s*#(.*)\z"
    bad = F.raise_error(F.concat(F.lit("not an exclusion line: "), line))
    checked = F.when(line.rlike(pattern), line).otherwise(bad)
    lines = spark.read.text(path).select(checked.alias("line"))
    return lines.select(
        F.regexp_extract("line", pattern, 1).cast("long").alias("doc_id"),
        F.trim(F.regexp_extract("line", pattern, 2)).alias("comment"),
    )


def read_wordlist(spark: SparkSession, path: str, stemmed: bool = True) -> DataFrame:
    """One column `word` from a JSON array of strings, stemmed by default."""
    text = spark.read.text(path, wholetext=True)
    words = text.select(F.explode(F.from_json("value", "array<string>")).alias("token"))
    if not stemmed:
        return words.select(F.col("token").alias("word"))
    return stem_vocabulary(words).select(F.col("stem").alias("word")).distinct()


def read_bigrams(spark: SparkSession, path: str) -> DataFrame:
    """`(w1, w2)` from CSV without a header."""
    return spark.read.schema("w1 string, w2 string").csv(path)


def write_bigrams(model: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """`w1,w2` from most to least frequent, without a header.  O1: equal frequencies
    are ordered by the words."""
    ordered = model.orderBy(F.desc("freq"), "w1", "w2")
    ordered.select("w1", "w2").write.mode(mode).csv(path)


def read_training_text(spark: SparkSession, path: str) -> DataFrame:
    """`(doc_id, tokens)` from text with one document per line."""
    words = F.filter(F.split("value", r"[ \t]+"), lambda t: t != "")
    return spark.read.text(path).select(
        F.monotonically_increasing_id().alias("doc_id"), words.alias("tokens")
    )


def write_training_text(
    docs: DataFrame, path: str, compression: str = "none", mode: str = "errorifexists"
) -> None:
    """One document per line, tokens separated by a space."""
    lines = docs.select(F.array_join("tokens", " ").alias("value"))
    lines.write.mode(mode).option("compression", compression).text(path)


def read_vectors(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """`(token, vec)` from text lines `token v1 .. vd`.

    With `header`, a line of two whole numbers is dropped where it is the first of its file: it
    starts in the block at offset 0 and no line of the block comes before it.
    """
    lines = spark.read.text(path)
    if header:
        # Numbers rise along each block, which is read as one; the first one of a file is its head.
        lines = lines.select("value", F.monotonically_increasing_id().alias("_n"), F.col("_metadata.file_path").alias("_f"),
                             F.col("_metadata.file_block_start").alias("_b"))
        head = lines.where("_b = 0").groupBy("_f").agg(F.min("_n").alias("_n"), F.min_by("value", "_n").alias("_v"))
        head = head.where(F.col("_v").rlike(r"\A\d+\s+\d+\s*\z")).select("_f", "_n")
        lines = lines.join(head, ["_f", "_n"], "left_anti").select("value")
    parts = F.split(F.rtrim("value"), r"\s+")
    vec = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: x.cast("float"))
    return lines.where("value <> ''").select(F.get(parts, F.lit(0)).alias("token"), vec.alias("vec"))


def write_vectors(
    vectors: DataFrame,
    path: str,
    header: bool = True,
    compression: str = "none",
    mode: str = "errorifexists",
) -> None:
    """W3 + W4: `token v1 .. vd`; the header line `words dimensions` comes first.

    The lines are range-partitioned by row order, so the parts read one after another are
    the file.
    """
    order = ["word_id"] if "word_id" in vectors.columns else ["token"]
    line = F.concat_ws(" ", "token", F.array_join(F.transform("vec", lambda x: x.cast("string")), " "))
    lines = vectors.select(F.lit(1).alias("_k"), *[F.col(c) for c in order], line.alias("value"))
    if header:
        head = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).select(
            F.lit(0).alias("_k"),
            *[F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in order],
            F.concat_ws(" ", "n", "d").alias("value"),
        )
        lines = head.unionByName(lines)
    lines.orderBy("_k", *order).select("value").write.mode(mode).option("compression", compression).text(path)


def write_vocabulary(vocab: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """`word cnt` lines from most to least frequent."""
    lines = vocab.orderBy("word_id").select(F.concat_ws(" ", "word", "cnt").alias("value"))
    lines.write.mode(mode).text(path)


def save_stage(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Write the result of a stage as parquet and go on from the written table."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path)


_TEXT = T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_xml:lang", T.StringType())])
_CLASS = T.StructType(
    [
        T.StructField("_rdf:about", T.StringType()),
        T.StructField("rdfs:label", T.ArrayType(_TEXT)),
        T.StructField(
            "rdfs:subClassOf", T.ArrayType(T.StructType([T.StructField("_rdf:resource", T.StringType())]))
        ),
    ]
)


def read_ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """`nodes (id, label)` and `edges (child, parent)` from OWL in RDF/XML.

    X2: the label is the first one, trimmed, or else the name in the address of the class.
    """
    raw = spark.read.format("xml").option("rowTag", "owl:Class").schema(_CLASS).load(path)
    raw = raw.where(F.col("`_rdf:about`").isNotNull())
    iri = F.col("`_rdf:about`")
    name = F.regexp_extract(iri, r"([^/#]*)\z", 1)
    label = F.trim(F.get("`rdfs:label`", F.lit(0))["_VALUE"])
    nodes = raw.select(iri.alias("id"), F.coalesce(label, name).alias("label"))
    edges = raw.select(iri.alias("child"), F.explode("`rdfs:subClassOf`").alias("p"))
    edges = edges.select("child", F.col("p")["_rdf:resource"].alias("parent"))
    return nodes, edges.where("parent is not null").distinct()


def write_leaf_paths(paths: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One label per level, padded with "" to the deepest path, as CSV without a header."""
    from wordloom.operators.ontology import pad_paths

    pad_paths(paths).drop("leaf_id").write.mode(mode).option("emptyValue", "").csv(path)
