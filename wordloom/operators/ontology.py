"""Paths, groups and similar tokens of an ontology."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.sql import one_of
from wordloom.functions.stem import stem_each
from wordloom.functions.tokens import plain_sql, tokenize
from wordloom.functions.wordlists import MORE_STOP_WORDS, STOP_WORDS
from wordloom.operators.bigrams import join_bigrams
from wordloom.operators.groups import pairs_in_groups
from wordloom.operators.lookup import match_elements
from wordloom.runtime import BROADCAST_ROWS, checkpoint, fits, release

# Root and branches of the food ontology, and the ending of a group label.
ROOT_LABEL = "food material"
PRUNED_LABELS = ("agency food product type", "food material by process", "multi-component food")
GROUP_SUFFIX = "food product"

# Leaves of one parent that one task reads; more are dealt over several.
CROWD = 100_000

# States of a way up: not at the root yet, at the root, meeting itself.
OPEN, CLOSED, CYCLE = 0, 1, 2


def leaf_paths(
    nodes: DataFrame,
    edges: DataFrame,
    root_label: str = ROOT_LABEL,
    pruned: Sequence[str] = PRUNED_LABELS,
    crowd: int = CROWD,
) -> DataFrame:
    """`(leaf_id, path)` for each way from the root to a leaf.

    `nodes` is `(id, label)`, `edges` is `(child, parent)`.  F11: no path goes through a
    pruned label, and a node with pruned children only is not a leaf.  The ways from inner nodes
    up to the root are closed by doubling (`root_paths`); leaves, the bulk of an ontology, are
    joined once with the ways of their parents.  The leaves of a parent with more than `crowd`
    are dealt over several tasks.  A cycle below the root is an error.
    """
    edges = edges.select("child", "parent").distinct()
    parents = edges.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    labelled = nodes.select("id", "label").join(parents, "id", "left")
    if pruned:
        labelled = labelled.where(~F.col("label").isin(*pruned))
    labelled = checkpoint(labelled)
    inner = labelled.where("children IS NOT NULL")
    leaves = labelled.where("children IS NULL").select("id", "label")
    ways = root_paths(inner.select("id", "label"), edges, root_label)

    # At most one parent for every `crowd` edges, so the table is small against the edges.
    crowded = inner.where(F.col("children") > crowd).select(
        F.col("id").alias("parent"), F.ceil(F.col("children") / crowd).cast("int").alias("parts")
    ).distinct()
    way_parts = ways.join(crowded.withColumnRenamed("parent", "node"), "node", "left").select(
        F.col("node").alias("parent"), "labels", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    )
    few = F.broadcast(crowded) if fits(crowded, BROADCAST_ROWS) else crowded
    dealt = edges.join(few, "parent", "left").withColumn(
        "part", F.pmod(F.xxhash64("child"), F.coalesce("parts", F.lit(1))).cast("int")
    )
    below = dealt.join(leaves.withColumnRenamed("id", "child"), "child").join(way_parts, ["parent", "part"])
    below = below.select(F.col("child").alias("leaf_id"), F.concat(F.reverse("labels"), F.array("label")).alias("path"))
    alone = leaves.where(F.col("label") == root_label)
    return below.union(alone.select("id", F.array("label")))


def root_paths(nodes: DataFrame, edges: DataFrame, root_label: str = ROOT_LABEL) -> DataFrame:
    """`(node, labels)` for each way from a node up to the root, labels from the node upwards.

    Round k holds the ways up of exactly 2^k steps (`OPEN`) and those of fewer steps that end at the
    root (`CLOSED`).  Open ways joined with both give the next round, each way once, so a
    hierarchy of n levels takes about log2(n) joins.  Ways that meet themselves are not followed; they
    mark a node on a cycle, and it is an error when the root leads to such a node.
    """
    first = edges.join(nodes.withColumnRenamed("id", "child"), "child").select(
        F.col("child").alias("node"), F.col("parent").alias("top"), F.array("child").alias("ids"), F.array("label").alias("labels"),
        F.lit(OPEN).alias("state"),
    )
    roots = nodes.where(F.col("label") == root_label)
    first = first.union(
        roots.select(F.col("id").alias("node"), F.col("id").alias("top"), F.array("id"), F.array("label"), F.lit(CLOSED))
    )
    state = checkpoint(first)
    while True:
        going, cyclic = state.agg(F.count_if(F.col("state") == OPEN), F.count_if(F.col("state") == CYCLE)).first()
        closed = state.where(F.col("state") == CLOSED)
        if cyclic and not closed.join(state.where(F.col("state") == CYCLE).select("node"), "node", "left_semi").isEmpty():
            raise ValueError("the ontology has a cycle below its root")
        if not going:
            return closed.select("node", "labels")
        upper = state.where(F.col("state") != CYCLE).select(
            F.col("node").alias("top"), F.col("top").alias("next"), F.col("ids").alias("more"), F.col("labels").alias("rest"),
            F.col("state").alias("then"),
        )
        pairs = state.where(F.col("state") == OPEN).drop("state").join(upper, "top")
        meets = F.arrays_overlap("ids", "more")
        joined = lambda a, b: F.when(~meets, F.concat(a, b)).otherwise(F.slice(a, 1, 0))
        longer = pairs.select(
            F.when(meets, F.col("top")).otherwise(F.col("node")).alias("node"), F.col("next").alias("top"),
            joined("ids", "more").alias("ids"), joined("labels", "rest").alias("labels"),
            F.when(meets, CYCLE).otherwise(F.col("then")).alias("state"),
        )
        last, state = state, checkpoint(state.where(F.col("state") != OPEN).union(longer))
        release(last)


def pad_paths(paths: DataFrame) -> DataFrame:
    """One column `level_0`, `level_1`, .. per step, "" behind the end of a path.

    The depth of the deepest path (G8) is read first, since it gives the columns.
    """
    depth = paths.agg(F.max(F.size("path"))).first()[0] or 0
    return paths.select(
        "leaf_id", *[F.coalesce(F.get("path", F.lit(k)), F.lit("")).alias(f"level_{k}") for k in range(depth)]
    )


def ontology_groups(paths: DataFrame, suffix: str = GROUP_SUFFIX) -> DataFrame:
    """`(grp, member)`: each leaf label under the nearest label that ends in `suffix`.

    A5: the search goes from the leaf upwards and includes it.  G6: without repeats.
    """
    nearest = F.get(F.filter(F.reverse("path"), lambda x: x.endswith(suffix)), F.lit(0))
    groups = paths.select(nearest.alias("grp"), F.element_at("path", -1).alias("member"))
    return groups.where(F.col("grp").isNotNull()).distinct()


def label_tokens(
    labels: DataFrame,
    vocab: DataFrame,
    column: str = "member",
    stop_words: Sequence[str] = (*STOP_WORDS, *MORE_STOP_WORDS),
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """add `tokens`, the stems of the words of a label that are in the vocabulary.

    `vocab` has a column `token`.  Numbers, white space, punctuation and stop words (as
    given, in this case) are left out.  The order of the words is kept.
    """
    kept = F.expr(f"filter(_words, t -> {plain_sql('t')} AND NOT {one_of('t', stop_words)})")
    words = labels.withColumn("_words", tokenize(F.col(column))).withColumn("_words", kept)
    stems = words.withColumn("_stems", stem_each("_words")).drop("_words")
    table = vocab.select(F.col("token").alias("key"), F.col("token").alias("value")).distinct()
    found = match_elements(stems, F.col("_stems"), table, "tokens", max_rows)
    return found.withColumn("tokens", F.array_compact("tokens")).drop("_stems")


def group_tokens(
    groups: DataFrame, vocab: DataFrame, bigrams: DataFrame | None = None, **options
) -> DataFrame:
    """`(grp, token)`: the tokens of all members of a group, without repeats.

    With a bigram model, U2: the joined tokens as well as the plain ones.  All tokens of a
    group are similar to one another; this table holds that relation in full, in space
    linear in the groups.  Retrofitting takes it as it is, and `similar_tokens` opens it
    up for the words that are asked.
    """
    tokens = label_tokens(groups, vocab, "member", **options)
    if bigrams is not None:
        joined = join_bigrams(tokens.withColumn("_plain", F.col("tokens")), bigrams)
        tokens = joined.withColumn("tokens", F.array_union("_plain", F.array_compact("tokens")))
    return tokens.select("grp", F.explode("tokens").alias("token")).distinct()


def similar_tokens(members: DataFrame, words: DataFrame) -> DataFrame:
    """`(token, neighbour)` for the asked `words` (column `token`): every other token
    that shares a group with the word, once."""
    pairs = pairs_in_groups(members.select("grp", F.col("token").alias("member")), words.select(F.col("token").alias("member")))
    return pairs.select(F.col("member").alias("token"), F.col("other").alias("neighbour"))
