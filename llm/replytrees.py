"""Chat formatting of reply trees.

Messages `(conv_id, node, parent, role, text, score)` form a forest in each conversation.  Root-to-leaf
paths come from iterative self-joins that double their reach: ancestors at distance 1, 2, 4 and so on,
then the messages between each leaf and its root, one row for each message of a path.  A
conversation of n turns takes about 2 * log2(n) joins.  Branches are ranked by the sum of their
scores, then by length and by the nodes on them, and the best `best` of each conversation are
formatted, each as one conversation.

*Template.*  A turn is `<|im_start|>role\\ntext<|im_end|>\\n`.  In texts and roles a backslash becomes two
and `<|` becomes `<\\|`, so no text can hold a mark; in roles a line break becomes `\\n`.
`unescape` takes it back exactly.  The loss mask is a list of `(start, stop)` ranges of code points of the
formatted string, one for each text of the assistant, without marks.

Null roles and texts are empty.  A null score counts as 0.  A message whose parent is not there
(or is null, or is itself) is a root.  Replies in a circle are an error.  Messages that repeat a `(conv_id, node)` are merged: the smallest row counts, `thread` never makes any.
A null `conv_id` is a conversation of its own.  An empty table gives an empty result.  Other columns
are not looked at.  Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from llm.scratch import Scratch

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
#: Paths may have up to two to this power messages; what is longer goes in a circle.
LONGEST = 40


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """Undo `escape`: backslash pairs are read from the left."""
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def unescape_role(role: Column) -> Column:
    # `\n` after an even number of backslashes is a line break; what is left is as in texts.
    broken = F.regexp_replace(role, r"\G((?:[^\\]|\\[\\|])*+)\\n", "$1\n")
    return unescape(broken)


def thread(rows: DataFrame) -> DataFrame:
    """Messages `(conv_id, node, parent, role, text, score)` of `(conv_id, turn, role, text)`.

    Each turn replies to the one before it; equal turns follow each other by role and text, a null
    turn comes first.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    numbered = rows.select("conv_id", node.alias("node"), "role", "text")
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return numbered.select("conv_id", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """`(conv_id, path, score)`: `path` is an array of `(node, role, text)` from root to leaf."""
    turn = F.struct("parent", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score"))
    rows = messages.groupBy("conv_id", "node").agg(F.min(turn).alias("m"))
    rows = scratch.save(
        rows.select(
            "conv_id", "node", F.when(F.col("m.parent") != F.col("node"), F.col("m.parent")).alias("parent"),
            F.coalesce("m.role", F.lit("")).alias("role"), F.coalesce("m.text", F.lit("")).alias("text"), "m.score",
        ),
        "messages",
    )
    # Ancestors at distance 1, 2, 4, ..: each table is the last one joined to itself.
    jumps = [rows.where("parent is not null").select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.col("parent").alias("up"))]
    known = rows.select(F.col("conv_id").alias("c"), F.col("node").alias("up"))
    jumps[0] = scratch.save(jumps[0].join(known, jumps[0]["c"].eqNullSafe(known["c"]) & (jumps[0]["up"] == known["up"]), "left_semi"), "up-0")
    while not jumps[-1].isEmpty():
        if len(jumps) > LONGEST:
            raise ValueError("replies in a circle")
        far = jumps[-1].toDF("c2", "n2", "up2")
        twice = jumps[-1].join(far, F.col("c").eqNullSafe(F.col("c2")) & (F.col("up") == F.col("n2")))
        jumps.append(scratch.save(twice.select("c", "n", F.col("up2").alias("up")), f"up-{len(jumps)}"))
    # Leaves are what no message replies to.
    replied = jumps[0].select("c", F.col("up").alias("p")).distinct()
    leaf = rows.join(replied, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("p")), "left_anti")
    steps = leaf.select("conv_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back"))
    # From the longest jump down, every message of a path is met once, by the binary digits of its distance.
    for k in range(len(jumps) - 2, -1, -1):
        on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n"))
        more = steps.join(jumps[k], on).select("conv_id", "leaf", F.col("up").alias("node"), F.col("back") + (1 << k))
        steps = scratch.save(steps.union(more), f"steps-{k}")
    said = rows.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "role", "text", "score")
    found = steps.join(said, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")))
    turn = F.struct((-F.col("back")).alias("at"), "node", "role", "text")
    whole = found.groupBy("conv_id", "leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.sum("score").alias("score"))
    path = F.transform("turns", lambda t: F.struct(t["node"].alias("node"), t["role"].alias("role"), t["text"].alias("text")))
    return whole.select("conv_id", path.alias("path"), "score")


def ranked(found: DataFrame, best: int | None) -> DataFrame:
    """Add `branch`, the rank of the path in its conversation from 1, and keep the first `best`."""
    order = [F.desc("score"), F.desc(F.size("path")), F.transform("path", lambda s: s["node"])]
    out = found.withColumn("branch", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    return out if best is None else out.where(F.col("branch") <= best)


def formatted(found: DataFrame) -> DataFrame:
    """Add `formatted` and `loss`, the ranges of the assistant's texts in it, to rows with `path`."""
    turns = F.transform(
        "path",
        lambda s: F.struct(
            F.concat(F.lit(START), escape_role(s["role"]), F.lit("\n")).alias("head"),
            escape(s["text"]).alias("body"),
            (s["role"] == ASSISTANT).alias("loss"),
        ),
    )
    tail = END + "\n"
    out = found.withColumn("_turns", turns)
    out = out.withColumn("formatted", F.array_join(F.transform("_turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), ""))
    # Places: a running sum over the lengths of the turns.
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("loss"))

    def step(have: Column, t: Column) -> Column:
        start = have["at"] + F.char_length(t["head"])
        stop = start + F.char_length(t["body"])
        span = F.struct(start.alias("start"), stop.alias("stop"))
        return F.struct(
            (stop + len(tail)).alias("at"), F.when(t["loss"], F.array_append(have["loss"], span)).otherwise(have["loss"]).alias("loss")
        )

    return out.withColumn("loss", F.aggregate("_turns", zero, step)["loss"]).drop("_turns")


def format_conversations(messages: DataFrame, best: int | None = None) -> DataFrame:
    """`(conv_id, branch, score, n_turns, formatted, loss)`: one row for each chosen path."""
    scratch = Scratch(messages.sparkSession, "replies")
    found = formatted(ranked(paths(messages, scratch), best))
    return found.select("conv_id", "branch", "score", F.size("path").cast("long").alias("n_turns"), "formatted", "loss")


def read_back(out: DataFrame) -> DataFrame:
    """Add `turns`, an array of `(role, text)`, and `learned`, the text under the mask, from the formatted string."""
    pieces = F.split("formatted", "\\Q" + START + "\\E")
    pieces = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        rest = F.substring(piece, F.char_length(role) + 2, F.char_length(piece))
        body = F.substring(rest, F.lit(1), F.char_length(rest) - len(END) - 1)
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    spans = F.transform("loss", lambda s: F.substring(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"]))
    return out.withColumns({"turns": F.transform(pieces, turn), "learned": F.array_join(F.transform(spans, unescape), "")})
