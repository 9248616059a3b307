"""A corpus pipeline of five stages over `documents`.

Each stage takes `(spark, docs, sf_dir)` and works on all documents that the stage before it kept.
Between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import balance, minhash, repeats, rules, wumanber
from llm.scratch import Scratch, collected, drop_unread

#: Columns of `documents`; all stages but the last return these.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Scratch folders that each stage made.
_MADE: dict[str, list[Scratch]] = {}


def _stage(f: Stage) -> Stage:
    """A stage that first deletes the tables of the stages before it, unless its `docs` still read them.

    So the result of a stage must be written before the next but one is called, as `run` does.
    """

    @wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [name for name, _ in STAGES]
        for before in names[: names.index(f.__name__)]:
            drop_unread(_MADE.get(before, []), docs)
        with collected(_MADE.setdefault(f.__name__, [])):
            return f(spark, docs, sf_dir)

    return stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the strict policy rejects."""
    return rules.ledger(docs).where(rules.passes(rules.STRICT)).select(*COLUMNS)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies, the one with the smallest id.

    Rows are documents of their own, also where an id is null or repeated: links join rows, and of rows
    with equal ids in one group the one with the least hash of its text stays.  Texts without words
    are linked with nothing; of those only rows that repeat both id and text are dropped.
    """
    scratch = Scratch(spark, "pipeline-near")
    # Written once, so a row has the same number whenever it is read.
    rows = scratch.save(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = minhash.near_duplicates(rows, percent=80, key="_row").select(
        F.col("doc_id").alias("_row"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("group")
    )
    order = F.struct("doc_id", F.md5(F.col("text").cast("binary")).alias("mark"), "lang", "source", "n_chars", "_row")
    ranked = rows.select("_row", order.alias("order")).join(groups, "_row")
    alone = F.when(F.col("group").isNull(), F.struct("order.doc_id", "order.mark"))
    first = ranked.groupBy("group", alone.alias("alone")).agg(F.min("order").alias("order"))
    kept = scratch.save(first.select("order._row"), "kept")
    # Those that go are fewer: as long as all tasks can be told of them, no text is shuffled.
    gone = scratch.save(rows.select("_row").join(kept, "_row", "left_anti"), "gone")
    few = minhash.fits_all_tasks(gone)
    left = rows.join(F.broadcast(gone), "_row", "left_anti") if few else rows.join(kept, "_row", "left_semi")
    return left.select(*COLUMNS)


@_stage
def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut what repeats an earlier string of 100 bytes, in whole characters; `n_chars` follows."""
    cut = repeats.without_repeats(docs.select("doc_id", "text"), 100).select("id", "mark", "kept")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({"id": F.coalesce("doc_id", F.lit(repeats.NO_ID)), "mark": F.xxhash64(text)})
    left = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.col("kept").cast("string"))
    out = keyed.join(cut, ["id", "mark"], "left").withColumn("left", left)
    n_chars = F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.char_length("left").cast("long"))
    return out.select("doc_id", F.col("left").alias("text"), "lang", "source", n_chars.alias("n_chars"))


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a ten-word window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return wumanber.decontaminate(docs.select(*COLUMNS), items).where("n_hit = 0").select(*COLUMNS)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add how often the mix takes each document, `copies`, so that sources meet their targets."""
    return balance.mix(docs.select(*COLUMNS))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Suffix arrays and Newton steps are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for (before, _), (name, stage) in zip([("", None), *STAGES], STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)  # read by no later stage
    return STAGES[-1][1](spark, docs, sf_dir)
