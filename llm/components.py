"""Connected components of a link table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """`(id, comp)` for every node of `links (a, b)`: the smallest node of its component.

    In each round a node is merged into the smallest of itself and its neighbours, and links
    are carried over to what is left.  The order is that of the ids in the first round, which
    ends stars at once, and that of a hash of the round later, so a chain shrinks by a constant
    share each time.  Sums before the shuffle keep a hub cheap; no list of neighbours is built.
    An empty table gives an empty one.
    """
    edges = scratch.save(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(),
        f"{name}-edges-0",
    )
    labels, turn = None, 0
    while not edges.isEmpty():
        ends = edges.select("a", "b").union(edges.select("b", "a")).toDF("x", "y")

        def rank(c: str):
            return F.struct((F.col(c) if turn == 0 else F.xxhash64(F.col(c), F.lit(turn))).alias("rank"), F.col(c).alias("to"))

        least = F.least(F.min(rank("y")), F.min(rank("x")))["to"]
        moved = scratch.save(ends.groupBy("x").agg(least.alias("to")), f"{name}-moved-{turn}")
        nxt = (
            edges.join(moved.toDF("a", "ta"), "a")
            .join(moved.toDF("b", "tb"), "b")
            .where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .distinct()
        )
        nxt = scratch.save(nxt, f"{name}-edges-{turn + 1}")
        if labels is None:
            new = moved.toDF("id", "comp")
        else:
            new = labels.join(moved.toDF("comp", "to"), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
        labels = scratch.save(new, f"{name}-labels-{turn}")
        scratch.drop(f"{name}-edges-{turn}", f"{name}-moved-{turn}", f"{name}-labels-{turn - 1}")
        edges, turn = nxt, turn + 1
    if labels is None:
        return edges.toDF("id", "comp")
    least = labels.groupBy("comp").agg(F.min("id").alias("least"))
    return scratch.save(labels.join(least, "comp").select("id", F.col("least").alias("comp")), f"{name}-components")
