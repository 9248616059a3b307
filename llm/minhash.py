"""Near duplicates by one-permutation hashing with optimal densification.

One hash of each distinct word shingle fills `bins` bins with their minimum.  An empty bin takes
the value of the first filled bin in an order of its own, drawn at random once for all texts
(optimal densification), so two texts agree in a bin with a probability equal to their
similarity.  `rows` bins in a row make a band; texts that share a band share a bucket.

*Stars bound the candidates.*  A bucket of m texts gives m - 1 pairs: its smallest text with each
other one.  Every pair is confirmed on the full sets, and components are formed.  A bucket
whose texts are then in one component is done.  In the others, stars with other centres follow
(drawn by hash in each bucket), over pairs of different components only.  What is still open
after `rounds` is settled exactly by prefixes: shingles are ordered from the rarest on, and two sets
that are similar enough share one of the first n - ceil(n * percent / 100) + 1 of their shingles;
pairs of different components that do so, and whose sizes allow a link, are confirmed like the others.
So no link that a bucket holds is lost, and a group of copies is never paired with itself.
`band_rows` lays the bands out for the asked similarity, so that few links share no bucket.

Texts with the same set of shingles are one class, with one sketch; its members are not expanded.

Null, empty texts and texts without words have no shingles and are linked with nothing.  A text of
fewer words than `width` is one shingle, all its words.  Rows that share a `doc_id` count as one
document in links, each row with its own set; a null `doc_id` is kept as it is and comes before
all others.  An empty table gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.components import components
from llm.scratch import Scratch
from llm.textops import mix, pieces, words

BINS, WIDTH = 480, 5
MISS = 3e-5  # chance that a pair that is just similar enough shares no band
NO_ID = -(2**63)  # stands for a null doc_id inside

#: Members of a star that are compared in one go, next to one copy of the centre.
STAR = 256
#: Ids that are sent to all tasks to pick their texts, eight bytes each.
BROADCAST = 200_000

_HIGH = np.uint64(32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the offsets of the texts in them."""
    hashes, at = words(data, offsets).grams(width)
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        hashes[i:j].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[at[:-1][at[:-1] < len(hashes)]] = True
    return hashes[new], np.concatenate(([0], np.cumsum(new)))[at]


def donor_orders(bins: int) -> np.ndarray:
    """For each bin the order in which it looks for a filled bin."""
    random = np.random.default_rng(11)
    return np.stack([random.permutation(bins) for _ in range(bins)]).astype(np.int32)


def sketch(hashes: np.ndarray, at: np.ndarray, bins: int, orders: np.ndarray) -> np.ndarray:
    """One-permutation sketches (texts x bins) of sorted sets, densified; all sets have elements."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    cell = owner * bins + (((hashes >> _HIGH) * np.uint64(bins)) >> _HIGH).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    table = np.zeros(n * bins, np.uint64)
    table[cell[first]] = np.minimum.reduceat(mix(hashes, 1), first)
    full = np.zeros(n * bins, bool)
    full[cell[first]] = True
    empty = np.flatnonzero(~full)
    for turn in range(bins):
        if not len(empty):
            break
        donor = empty // bins * bins + orders[empty % bins, turn]
        hit = full[donor]
        table[empty[hit]] = table[donor[hit]]
        empty = empty[~hit]
    return table.reshape(n, bins)


def bands(table: np.ndarray, rows: int) -> np.ndarray:
    """One key for each band of `rows` bins; the number of the band is part of it."""
    n, bins = table.shape
    odd = mix(np.arange(1, rows + 1, dtype=np.uint64), 2) | np.uint64(1)
    keys = (table[:, : bins // rows * rows].reshape(n, bins // rows, rows) * odd).sum(axis=2, dtype=np.uint64)
    return mix(keys + np.arange(bins // rows, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def miss(percent: int, bins: int, rows: int) -> float:
    """The chance that two texts of this similarity agree in no band of `rows` bins."""
    return (1 - (percent / 100) ** rows) ** (bins // rows)


def band_rows(percent: int, bins: int = BINS) -> int:
    """The most bins per band, and so the fewest candidates, that miss no more than `MISS` at `percent`.

    1 if even that misses more, as it does with 480 bins below 3 percent.
    """
    return max((r for r in range(1, bins + 1) if miss(percent, bins, r) <= MISS), default=1)


def _digests(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """16 bytes for each set, from two independent sums over its elements and its size."""
    filled = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, 2), np.uint64)
    if len(filled):
        size = np.diff(at)[filled].astype(np.uint64)
        for k in (0, 1):
            out[filled, k] = mix(np.add.reduceat(mix(hashes, 3 + k), at[filled]) + size, 5)
    return out


def _sketches(width: int, bins: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = donor_orders(bins)
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column("text"), rows=1024):
                hashes, at = shingle_sets(data, offsets, width)
                size = np.diff(at)
                some = np.flatnonzero(size)
                digest = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(16), j - i, [None, pa.py_buffer(_digests(hashes, at).tobytes())]
                )
                keys = np.zeros((0, bins // rows), np.uint64)
                if len(some):
                    keys = bands(sketch(hashes, np.append(at[some], at[-1]), bins, orders), rows)
                ends = np.concatenate(([0], np.cumsum(size > 0))) * keys.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(i, j - i),
                        pa.array(size, pa.int64()),
                        digest.cast(pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys.ravel().view(np.int64))),
                    ],
                    ["id", "n_shingles", "digest", "bands"],
                )

    return run


def fits_all_tasks(ids: DataFrame) -> bool:
    """Whether written `ids` are few enough to be sent to all tasks, so that the texts joined with them stay in place."""
    return ids.limit(BROADCAST + 1).count() <= BROADCAST


def sent(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if fits_all_tasks(ids) else ids


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """`(a, b, inter, total)` for each of `pairs (a, b)`: sizes of intersection and union of the full sets.

    Pairs are dealt by their centre `a` and a share of its members, so a hub is worked on by many
    tasks, each with one copy of the centre's text.  A task walks through its sorted rows and
    holds one centre and one member.  Where an id has several texts, the most similar ones count.
    """
    share = F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("many") / STAR))).cast("int")
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("many"))
    pairs = pairs.join(many, "a").select("a", "b", share.alias("share"))
    centres = pairs.select("a", "share").distinct().join(texts.toDF("a", "text"), "a")
    members = pairs.join(texts.toDF("b", "text"), "b")
    rows = centres.select("a", "share", F.lit(None).cast("long").alias("b"), F.lit(0).alias("kind"), "text").union(
        members.select("a", "share", "b", F.lit(1), "text")
    )
    dealt = rows.repartition("a", "share").sortWithinPartitions("a", "share", "kind", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, sets = None, []
        for batch in batches:
            a, share, b, kind = (batch.column(c).to_pylist() for c in ("a", "share", "b", "kind"))
            out = []
            for i, j, data, offsets in pieces(batch.column("text")):
                hashes, at = shingle_sets(data, offsets, width)
                for k in range(i, j):
                    own = hashes[at[k - i] : at[k - i + 1]]
                    if kind[k] == 0:
                        if (a[k], share[k]) != centre:
                            centre, sets = (a[k], share[k]), []
                        sets.append(own.copy())
                    elif len(own):
                        best = (0, 1)
                        for other in sets:
                            if len(other):
                                x = np.searchsorted(other, own)
                                x[x == len(other)] = 0
                                inter = int((other[x] == own).sum())
                                total = len(own) + len(other) - inter
                                best = max(best, (inter, total), key=lambda p: p[0] / p[1])
                        out.append((a[k], b[k], *best))
            columns = [pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), (), ()))]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "inter", "total"])

    found = dealt.mapInArrow(run, "a long, b long, inter long, total long")
    best = found.groupBy("a", "b").agg(F.max(F.struct(F.col("inter") / F.col("total"), "inter", "total")).alias("x"))
    return best.select("a", "b", "x.inter", "x.total", (F.lit(100) * F.col("x.inter") >= percent * F.col("x.total")).alias("linked"))


def rare_pairs(nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """`(a, b)`, pairs of `nodes (id, comp, text)` of different components that share a rare shingle.

    Holds every pair that is `percent` similar or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column("text")):
                hashes, at = shingle_sets(data, offsets, width)
                size = np.diff(at)
                owner = pa.array(np.repeat(np.arange(i, j), size))
                columns = [batch.column(c).take(owner) for c in ("id", "which", "comp")]
                columns += [pa.array(np.repeat(size, size), pa.int64()), pa.array(hashes.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "which", "comp", "n", "shingle"])

    nodes = nodes.select("id", F.xxhash64("text").alias("which"), "comp", "text")
    sets = nodes.mapInArrow(run, "id long, which long, comp long, n long, shingle long")
    often = sets.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # Shingles of one text only cannot be shared; they come first and use up places of the prefix.
    shared = sets.join(often, "shingle").withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("id", "which")))
    place = F.row_number().over(Window.partitionBy("id", "which").orderBy("df", "shingle")) + F.col("n") - F.col("shared")
    prefix = shared.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    # At the first shingle that two sets share, no more than the shorter rest can follow.
    one, two = prefix.select("shingle", "id", "comp", "n", "place"), prefix.selectExpr("shingle", "id b", "comp cb", "n nb", "place pb")
    most = F.least(F.col("n") - F.col("place"), F.col("nb") - F.col("pb")) + 1
    enough = most * (100 + percent) >= (F.col("n") + F.col("nb")) * percent
    pairs = one.join(two, "shingle").where((F.col("id") < F.col("b")) & (F.col("comp") != F.col("cb")) & enough)
    return pairs.select(F.col("id").alias("a"), "b").distinct()


def near_duplicates(
    docs: DataFrame,
    percent: int = 80,
    width: int = WIDTH,
    bins: int = BINS,
    rows: int | None = None,
    rounds: int = 2,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """`(doc_id, n_shingles, component_id, kept)` for each row of `docs`.

    Two documents are linked if 100 * intersection >= percent * union of their sets of shingles.
    `component_id` is the smallest id that links reach, `kept` is true for that document.
    `rows` is the number of bins in a band; it follows from `percent` if not given.
    """
    rows = rows or band_rows(percent, bins)
    scratch = Scratch(docs.sparkSession, "minhash")
    texts = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("text"))
    sketches = scratch.save(
        texts.mapInArrow(_sketches(width, bins, rows), "id long, n_shingles long, digest binary, bands array<long>"),
        "sketches",
    )
    # One row for each class of texts with the same set; its node is the smallest id.
    classes = sketches.where("n_shingles > 0").groupBy("digest")
    classes = scratch.save(
        classes.agg(F.min("id").alias("node"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes"
    )
    # Bands are half of what these tables hold and are read once more only: kept without them from here on.
    banded, sketches = classes, scratch.save(sketches.drop("bands"), "texts-of-classes")
    scratch.drop("sketches")
    keys = banded.select("node", "n", F.explode("bands").alias("bucket"))
    stars = keys.groupBy("bucket").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("many")).where("many > 1")
    members = scratch.save(keys.join(stars.drop("many"), "bucket"), "members")
    classes = scratch.save(banded.drop("bands"), "nodes")
    scratch.drop("classes")

    def settle(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.save(pairs.select("a", "b"), f"pairs-{name}")
        ids = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"ids-{name}")
        needed = scratch.save(texts.join(sent(ids), "id", "left_semi"), f"texts-{name}")
        tried = scratch.save(confirm(pairs, needed, width, percent), name)
        scratch.drop(f"pairs-{name}", f"ids-{name}", f"texts-{name}")
        return tried

    def fits(a: str, b: str):
        return F.least(a, b) * 100 >= F.greatest(a, b) * percent

    sizes = members.groupBy("node").agg(F.min("n").alias("n"))
    first = members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"), F.col("n").alias("nb"))
    first = first.distinct().join(sizes.toDF("a", "na"), "a").where(fits("na", "nb"))
    first = scratch.save(first.select("a", "b").distinct(), "first")
    # Texts that share a bucket with others, read by all rounds.
    ids = scratch.save(members.select(F.col("node").alias("id")).distinct(), "ids")
    texts = scratch.save(texts.join(sent(ids), "id", "left_semi").distinct(), "texts")
    # Rows that repeat an id are one document: the classes of its texts are joined through the id.
    often = sketches.groupBy("id").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("id")
    through = sketches.where("n_shingles > 0").join(often, "id").select("id", "digest").distinct()
    through = through.join(classes.select("digest", "node"), "digest").where("node <> id")
    through = scratch.save(through.select(F.col("node").alias("a"), F.col("id").alias("b")).distinct(), "through")
    tried = settle(first, "tried-0")
    near = tried
    comps = components(tried.where("linked").select("a", "b").union(through), scratch, "stars-0")

    def unsettled(members: DataFrame, comps: DataFrame, name: str) -> DataFrame:
        """The members, with their component, of the buckets that hold more than one component."""
        now = members.drop("comp").join(comps.toDF("node", "comp"), "node", "left")
        now = now.withColumn("comp", F.coalesce("comp", "node"))
        mixed = now.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
        return scratch.save(now.join(mixed.select("bucket"), "bucket"), name)

    left = unsettled(members.select("bucket", "node", "n"), comps, "open-0")
    scratch.drop("members", "first", "ids")
    for turn in range(1, rounds + 2):
        if left.isEmpty():
            break
        if turn <= rounds:
            rank = F.struct(F.xxhash64("node", "bucket", F.lit(turn)), "node", "n", "comp")
            other = left.groupBy("bucket").agg(F.min(rank).alias("c")).selectExpr("bucket", "c.node a", "c.n na", "c.comp ca")
            pairs = left.join(other, "bucket").where(F.col("comp") != F.col("ca")).where(fits("n", "na"))
            pairs = pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        else:
            nodes = left.select("node", "comp").distinct()
            pairs = rare_pairs(texts.join(nodes.withColumnRenamed("node", "id"), "id"), width, percent)
        tried = settle(pairs.join(near.select("a", "b"), ["a", "b"], "left_anti"), f"tried-{turn}")
        near = scratch.save(near.union(tried), f"near-{turn}")
        scratch.drop(f"near-{turn - 1}", f"tried-{turn}", *(["tried-0"] if turn == 1 else []))
        comps = components(near.where("linked").select("a", "b").union(through), scratch, f"stars-{turn}")
        if turn <= rounds:
            left = unsettled(left, comps, f"open-{turn}")
            scratch.drop(f"open-{turn - 1}")
    scratch.drop("texts")
    # Classes that are more than one text, or joined to others, get a row; all else is itself.
    nodes = classes.select("digest", "node").join(comps.toDF("node", "comp"), "node", "left")
    nodes = nodes.select("digest", F.coalesce("comp", "node").alias("comp"))
    out = sketches.where("n_shingles > 0").select("id", "n_shingles", "digest").join(nodes, "digest", "left").drop("digest")
    # A row without shingles follows the other rows of its id.
    none = sketches.where("n_shingles = 0").select("id", "n_shingles").join(comps.toDF("id", "comp"), "id", "left")
    out = out.unionByName(none)
    back = lambda c: F.nullif(c, F.lit(NO_ID))
    comp = F.coalesce("comp", "id")
    return out.select(
        back(F.col("id")).alias("doc_id"), "n_shingles", back(comp).alias("component_id"), (F.col("id") == comp).alias("kept")
    )
