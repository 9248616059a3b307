"""Mixing sources to target weights by entropy balancing.

*Targets.*  Sources in the order of their names (by code point, null last) have the weights of
`WEIGHTS`, over and over, and share the words of all documents.  No target exceeds `limit` times
the words of its source; what is over goes to the others by weight until none exceeds it.

*Rates.*  Each document gets a rate, how many copies of it the mix takes on average.  The rates
are those with the least relative entropy to "one copy each" under two kinds of constraints: the
words of a source meet its target, and no rate exceeds `limit`.  Their form is
min(limit, exp(lambda * size / mean size)), with one multiplier for each source.  The dual is convex; Newton
steps find its minimum, with a bracket that catches steps which leave it.  An iteration sums
words and slopes over the table of different (source, size) pairs, which is made once, so its cost
follows that table and not the number of documents.

*Copies.*  The whole part of a rate is taken as it is.  The rest is rounded along runs of about
`STRATUM` documents of a source, in the order of their sizes: a document gets one more copy when the
running sum of the rests passes a whole number, from a start that depends on the run.  So a
source misses its target by a few documents for each run at most, and equal inputs give equal mixes.

Everything is DataFrame functions.  A null or empty text has size 0 and is never taken.  A null
source is a source of its own.  Repeated rows are separate documents.  Sources without any words have
target 0.  An empty table gives an empty result.  Columns of the input are kept, except those
that have the names of the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from llm.scratch import Scratch
from llm.textops import apart

WEIGHTS = (5, 2, 1)
LIMIT = 3.0
STRATUM = 1000
#: Relative distance to the target at which a source is done.
CLOSE = 1e-9
#: Relative width at which a bracket cannot be halved any more.
NARROW = 1e-15

RESULTS = ("size", "source_size", "target", "rate", "copies", "taken")


def count_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(spaced, " "), lambda w: w != "")), F.lit(0)).cast("long")


def targets(sources: DataFrame, scratch: Scratch, weights=WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """Add `target` to `(source, words)`, one row for each source."""
    # One row for each source, numbered along ranges of names.
    ranked = scratch.save(
        sources.repartitionByRange(F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("place", F.monotonically_increasing_id()),
        "ranked",
    )
    part = F.shiftright("place", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranked.groupBy(part.alias("part"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    number = F.pmod(F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before"), F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number + 1).cast("int"))
    rows = ranked.withColumn("part", part).join(offsets, "part").select("source", "words", weight.alias("weight"))
    rows = scratch.save(rows.withColumn("capped", F.lit(False)), "weighted")
    free = ~F.col("capped")
    most = F.col("words") * F.lit(limit)
    turn = 0
    while True:
        total = rows.agg(
            F.sum("words").alias("all"),
            F.sum(F.when(free, F.col("weight"))).alias("weight"),
            F.sum(F.when(~free, most)).alias("taken"),
        ).first()
        rest = float(total["all"] or 0) - float(total["taken"] or 0)
        share = rest / total["weight"] if total["weight"] else 0.0
        over = free & (F.col("weight") * F.lit(share) > most)
        if rows.where(over).isEmpty():
            return rows.select("source", "words", F.when(free, F.col("weight") * F.lit(share)).otherwise(most).alias("target"))
        turn += 1
        rows = scratch.save(rows.withColumn("capped", F.col("capped") | over), f"capped-{turn}")


def multipliers(sizes: DataFrame, goals: DataFrame, scratch: Scratch, limit: float = LIMIT) -> DataFrame:
    """Add `lambda` and `mean` to the sources of `goals`, by Newton steps on the dual.

    `sizes (source, size, n)` has the number of documents of each size.  A source whose target is
    `limit` times its words gets an infinite multiplier, all its documents at the limit.
    """
    words = sizes.where("size > 0").groupBy(F.col("source").alias("s")).agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least")
    )
    state = goals.join(words, F.col("source").eqNullSafe(F.col("s")), "left")
    top = F.log(F.lit(limit)) * F.col("mean") / F.col("least")  # here every rate is at the limit
    full = (F.col("target") >= F.col("words") * limit * (1 - 1e-12)) | (F.col("words") == 0)
    state = state.select(
        "source", "words", "target", "mean", F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("low"),
        F.when(~full, top).alias("high"), full.alias("done"), full.alias("full"),
    )
    state = scratch.save(state, "state-0")
    turn = 0
    while not state.where("not done").isEmpty():
        now = state.where("not done").select(F.col("source").alias("s"), "mean", "lam")
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.col("lam") * x)
        inside = rate < limit
        sums = (
            sizes.where("size > 0")
            .join(now, F.col("source").eqNullSafe(F.col("s")))
            .groupBy("source")
            .agg(
                F.sum(F.col("n") * F.col("size") * F.least(rate, F.lit(limit))).alias("got"),
                F.sum(F.when(inside, F.col("n") * F.col("size") * x * rate)).alias("slope"),
            )
            .toDF("s", "got", "slope")
        )
        gap = F.col("got") - F.col("target")
        new = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
        close = F.abs(gap) <= F.col("target") * CLOSE
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        narrow = high - low <= F.greatest(F.abs(low), F.abs(high)) * NARROW
        over = F.coalesce(close, F.lit(False)) | F.coalesce(narrow, F.lit(False))
        new = new.withColumns({"low": low, "high": high, "done": F.col("done") | over})
        step = F.col("lam") - gap / F.col("slope")
        # Without a lower bound yet, go down by doubling.
        other = F.when(F.col("low").isNull(), F.least(F.col("lam") * 2, F.lit(-1.0))).otherwise((F.col("low") + F.col("high")) / 2)
        good = (step > F.coalesce("low", F.lit(float("-inf")))) & (step < F.col("high"))
        lam = F.when(F.col("done"), F.col("lam")).when(F.coalesce(good, F.lit(False)), step).otherwise(other)
        state = scratch.save(new.withColumn("lam", lam).select(*state.columns), f"state-{turn + 1}")
        scratch.drop(f"state-{turn}")
        turn += 1
    return state


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    limit: float = LIMIT,
    stratum: int = STRATUM,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    size: Column | None = None,
) -> DataFrame:
    """The rows of `docs` with `size, source_size, target, rate, copies, taken`.

    `size` is the number of words of a row, by default counted in `text`.
    `taken` = `copies` * `size` is the number of words that the mix takes from the document;
    no document is taken more than `limit` times.
    """
    scratch = Scratch(docs.sparkSession, "balance")
    keep = [c for c in docs.columns if c.lower() not in RESULTS]
    own = apart(keep)  # columns of this function, whatever the input's are called
    ties = [F.xxhash64(F.col(text))] if text in docs.columns else []
    docs = docs.withColumn("size", count_words(F.col(text)) if size is None else size).select(*keep, "size")
    # Sums of floats differ in their last digits from run to run; the multipliers are rounded beyond that.
    slim = scratch.save(docs.select(F.col(source).alias("source"), "size").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    totals = slim.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    goals = targets(totals, scratch, weights, limit)
    state = multipliers(slim, goals, scratch, limit)
    counts = slim.groupBy("source").agg(F.sum("n").alias("n")).toDF("c", "n")
    state = state.join(counts, F.col("source").eqNullSafe(F.col("c")), "left").select(
        F.col("source").alias(f"{own}source"),
        F.col("words").alias("source_size"),
        F.col("target").alias("target"),
        F.col("mean").alias(f"{own}mean"),
        F.when(~F.col("full"), F.round("lam", 9)).alias(f"{own}lam"),
        F.greatest(F.lit(1), F.ceil(F.col("n") / stratum)).alias(f"{own}runs"),
    )
    state = scratch.save(state, "rates")
    rate = F.when(F.col("size") == 0, F.lit(0.0)).when(F.col(f"{own}lam").isNull(), F.lit(float(limit)))
    rate = rate.otherwise(F.least(F.lit(float(limit)), F.exp(F.col(f"{own}lam") * F.col("size") / F.col(f"{own}mean"))))
    run = F.pmod(F.xxhash64(F.col(key)), F.col(f"{own}runs"))
    rated = docs.join(state, F.col(source).eqNullSafe(F.col(f"{own}source"))).withColumns({"rate": rate, f"{own}run": run})
    rest = F.col("rate") - F.floor("rate")
    along = Window.partitionBy(f"{own}source", f"{own}run").orderBy("size", F.col(key), *ties)
    upto = F.sum(rest).over(along.rowsBetween(Window.unboundedPreceding, 0))
    start = F.pmod(F.xxhash64(f"{own}run", f"{own}source"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    # A hair is added so that sums of many rests do not miss a whole number by rounding.
    whole = F.floor(F.col(f"{own}upto") + F.col(f"{own}start") + 1e-9) - F.floor(F.col(f"{own}upto") - F.col(f"{own}rest") + F.col(f"{own}start") + 1e-9)
    out = rated.withColumns({f"{own}rest": rest, f"{own}start": start}).withColumn(f"{own}upto", upto)
    copies = (F.floor("rate") + F.greatest(F.lit(0), F.least(F.lit(1), whole))).cast("long")
    out = out.withColumn("copies", F.least(copies, F.lit(int(limit)).cast("long")))
    return out.withColumn("taken", F.col("copies") * F.col("size")).select(*keep, *RESULTS)
