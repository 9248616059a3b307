"""Jaccard join of word n-gram sets with parity sketches.

*Sketch.*  A set of n tokens (hashes of word n-grams) is XORed into bits: each token flips one bit.  Tokens in
both of two sets cancel, so the Hamming distance of two sketches is at most their symmetric difference.
Sets that are `percent` similar, the larger of b tokens, differ in at most T = 2 b (100 - percent) / (100 + percent)
tokens.

*Pigeonhole join.*  Sets are laid out by size band; a band has the T of its largest size, and a sketch of
m = T + 1 + spare blocks of 128 bits.  No more than T blocks hold a differing token, so two similar sets agree in at
least 1 + spare blocks.  A set is laid out for its own band and for each band that a larger partner may be in, and
the join key is a block with its band and place.  Blocks of less than two tokens say little and would be
hot keys: they are left out by sets that have at most `spare` of them, since then one of the blocks they share with
any partner has more.  Sets with more such blocks keep them all, so no pair is lost.

*Verification.*  Sets that may link, by size and sketch, with no other set of a key leave it before any pair is
made, but for keys of more than `LOT` sets.  A key of m sets first gives a star of m - 1 pairs.  Pairs are screened by the Hamming distance of a
second sketch of two to four bits a token (first folded to 256 bits, then to the shorter one's length), and
confirmed on the full sets.  Linked sets form components.  Keys whose sets are then in one component are done; in the others stars
from other centres follow, and after `rounds` all sets of different components are compared, by a join in small groups and in tiles of `TILE`
sketches in large ones, and each pair that passes is confirmed.  Keys with the same sets are compared once.  So
every link between components is found, and a group of copies is never expanded into pairs.

Texts with equal sets are one class and are joined through it.  Null, empty texts and texts without words have no
tokens and are linked with nothing.  A text of fewer words than `width` is one token, all its words.  Rows that
share a `doc_id` count as one document in links, each with its own set; a null `doc_id` is kept and comes before all
others.  An empty table gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.components import components
from llm.minhash import NO_ID, _digests, confirm, sent, shingle_sets
from llm.scratch import Scratch
from llm.textops import mix, pieces

WIDTH = 4
#: Sketches that a task compares with another lot of as many.
TILE = 512
#: Groups of up to so many sets are compared by a join, larger ones in tiles.
SMALL = 32
#: Buckets of up to so many sets are screened before pairs are made.
LOT = 4096
#: Bits of the folded sketch that goes with a set as four numbers.
SHORT = 256
WORDS = ("s0", "s1", "s2", "s3")
#: Ratio of the largest to the smallest size of a band, in tenths.
RATIO = 14


class Bands:
    """Size bands up to a size: the largest size, distance bound, spare and number of blocks of each."""

    def __init__(self, percent: int, largest: int = 1 << 40):
        high = [1]
        while high[-1] < largest:
            high.append(max(high[-1] + 1, high[-1] * RATIO // 10))
        self.percent = percent
        self.high = np.array(high, np.int64)
        #: Sets of a band and smaller ones differ in at most so many tokens.
        self.bound = 2 * self.high * (100 - percent) // (100 + percent)
        self.spare = np.where(self.bound < 3, 0, 1 + self.bound // 16)
        self.blocks = self.bound + 1 + self.spare

    def of(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last band in which a set may be the smaller or the larger one of a pair."""
        # A partner has at most size * 100 / percent tokens.
        return np.searchsorted(self.high, size), np.searchsorted(self.high, size * 100 // self.percent)


def block_keys(hashes: np.ndarray, at: np.ndarray, band: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of sets laid out in one band each, and the offsets of the sets in them.

    `hashes` are sorted within a set.  The place of a token's block comes from its upper bits, so the tokens of a
    block lie together.
    """
    m, spare = bands.blocks[band], bands.spare[band]
    base = np.concatenate(([0], np.cumsum(m)))
    owner = np.repeat(np.arange(len(band)), np.diff(at))
    place = (((hashes >> np.uint64(32)) * m[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    cell = base[owner] + place
    many = np.bincount(cell, minlength=base[-1])
    bit = mix(hashes, 21)
    flip = np.uint64(1) << (bit & np.uint64(63))
    upper = (bit >> np.uint64(6)) & np.uint64(1) == 1
    first = np.flatnonzero(many)
    start = np.concatenate(([0], np.cumsum(many)))[first]
    word = np.zeros((2, base[-1]), np.uint64)
    for half, chosen in enumerate((~upper, upper)):
        if len(first):
            word[half, first] = np.bitwise_xor.reduceat(np.where(chosen, flip, np.uint64(0)), start)
    of = np.repeat(np.arange(len(band)), m)
    name = (band[of].astype(np.uint64) << np.uint64(40)) + (np.arange(base[-1]) - base[of]).astype(np.uint64)
    keys = mix(mix(mix(word[0], 22) ^ word[1], 23) + name, 24)
    weak = many < 2
    few = np.bincount(of, weak, minlength=len(band)) <= spare
    kept = ~(weak & few[of])
    return keys[kept], np.concatenate(([0], np.cumsum(np.bincount(of[kept], minlength=len(band)))))


def sketches(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches of sets as bytes, a power of two of at least two bits a token and `SHORT` bits, and their offsets."""
    size = np.diff(at)
    bits = np.where(size > 0, SHORT << np.ceil(np.log2(np.maximum(2 * size, SHORT) / SHORT)).astype(np.int64), 0)
    base = np.concatenate(([0], np.cumsum(bits)))
    owner = np.repeat(np.arange(len(size)), size)
    bit = (mix(hashes, 25) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.zeros(base[-1], np.uint8)
    np.bitwise_and(np.bincount(base[owner] + bit, minlength=base[-1]), 1, out=odd, casting="unsafe")
    return np.packbits(odd, bitorder="little"), base // 8


def fold(sketch: np.ndarray, width: int) -> np.ndarray:
    """Rows of bytes XORed down to `width`; the distance of two rows only shrinks."""
    while sketch.shape[1] > width:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def may_link(size_a, size_b, distance, percent: int):
    """Whether sets of these sizes may be `percent` similar, their difference being `distance` or more."""
    return (np.minimum(size_a, size_b) * 100 >= np.maximum(size_a, size_b) * percent) & (
        distance * (100 + percent) <= (size_a + size_b) * (100 - percent)
    )


def _prepare(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column("text"), rows=1024):
                hashes, at = shingle_sets(data, offsets, width)
                size = np.diff(at)
                low, high = bands.of(size)
                # Each set once for each of its bands; a set whose bands allow no difference has no keys.
                many = np.where(size > 0, high - low + 1, 0)
                of = np.repeat(np.arange(j - i), many)
                band = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                some = bands.bound[band] > 0
                of, band = of[some], band[some]
                token = np.repeat(at[of], size[of]) + np.arange(size[of].sum()) - np.repeat(np.cumsum(size[of]) - size[of], size[of])
                keys, ends = block_keys(hashes[token], np.concatenate(([0], np.cumsum(size[of]))), band, bands)
                bound = ends[np.searchsorted(of, np.arange(j - i + 1))].astype(np.int32)
                parity, where = sketches(hashes, at)
                digest = pa.Array.from_buffers(pa.binary(16), j - i, [None, pa.py_buffer(_digests(hashes, at).tobytes())])
                sketch = pa.Array.from_buffers(
                    pa.binary(), j - i, [None, pa.py_buffer(where.astype(np.int32).tobytes()), pa.py_buffer(parity.tobytes())]
                )
                short = np.zeros((j - i, len(WORDS)), np.uint64)
                if len(parity):
                    lines = parity.view(np.uint64).reshape(-1, len(WORDS))
                    short[size > 0] = np.bitwise_xor.reduceat(lines, where[:-1][size > 0] // (SHORT // 8), axis=0)
                columns = [batch.column("id").slice(i, j - i), pa.array(size, pa.int64()), digest.cast(pa.binary()), sketch]
                columns += [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in short.T]
                columns.append(pa.ListArray.from_arrays(pa.array(bound), pa.array(keys.view(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_shingles", "digest", "sketch", *WORDS, "keys"])

    return run


def _matrices(batch: pa.RecordBatch, one: str, two: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """`(rows, sketches of one, sketches of two)`, folded to the same width, for rows of equal widths."""
    wide = [pc.binary_length(batch.column(c)).to_numpy().astype(np.int64) for c in (one, two)]
    shape = wide[0] << 32 | wide[1]
    for s in np.unique(shape):
        rows = np.flatnonzero(shape == s)
        width = min(int(s) >> 32, int(s) & 0xFFFFFFFF)
        found = []
        for c in (one, two):
            x = np.frombuffer(b"".join(batch.column(c).take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1)
            found.append(np.ascontiguousarray(fold(x, width)).view(np.uint64))
        yield rows, *found


def short_gap(a: str = "a", b: str = "b") -> Column:
    """The distance of two folded sketches, whose columns end in the names given."""
    return sum((F.bit_count(F.col(f"{w}{a}").bitwiseXOR(F.col(f"{w}{b}"))) for w in WORDS[1:]), F.bit_count(F.col(f"s0{a}").bitwiseXOR(F.col(f"s0{b}"))))


def possible(percent: int) -> Column:
    """`may_link` for rows with `na`, `nb` and folded sketches."""
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return fits & (short_gap() * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))


def screen(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The `pairs (a, b)` whose sizes and sketches allow a link; `classes (node, n, sketch, s0 .. s3)`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            gap = np.zeros(len(na), np.int64)
            for rows, x, y in _matrices(batch, "sa", "sb"):
                gap[rows] = np.bitwise_count(x ^ y).sum(axis=1)
            kept = pa.array(may_link(na, nb, gap, percent))
            yield batch.select(["a", "b"]).filter(kept)

    joined = pairs
    for end in ("a", "b"):
        joined = joined.join(classes.select("node", "n", *WORDS).toDF(end, f"n{end}", *(w + end for w in WORDS)), end)
    joined = joined.where(possible(percent)).select("a", "b", "na", "nb")
    sketch = classes.select("node", "sketch")
    joined = joined.join(sketch.toDF("a", "sa"), "a").join(sketch.toDF("b", "sb"), "b")
    return joined.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _middle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches folded to half a bit to one bit a token, of `SHORT` bits at least: enough to tell unlike sets apart."""
    for batch in batches:
        found = []
        for x in batch.column("sketch").to_pylist():
            found.append(fold(np.frombuffer(x, np.uint8)[None, :], max(SHORT // 8, len(x) // 4)).tobytes())
        columns = [batch.column("node"), batch.column("n"), pa.array(found, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["node", "n", "middle"])


def _hopeful(percent: int):
    """The rows, sorted by bucket and size, that may link with another row of their bucket.

    All rows meet the next row of their bucket, then the next but one, and so on until sizes differ too much.
    """

    def folded(middle: pa.ChunkedArray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
        """Widths of the sketches and, for each width, the place of the rows that have it or more in a matrix of that width."""
        wide, held = pc.binary_length(middle).to_numpy(), {}
        for w in np.unique(wide):
            rows = np.zeros((int((wide >= w).sum()), int(w) // 8), np.uint64)
            place = np.cumsum(wide >= w) - 1
            for own in np.unique(wide[wide >= w]):
                some = np.flatnonzero(wide == own)
                x = np.frombuffer(b"".join(middle.take(pa.array(some)).to_pylist()), np.uint64).reshape(len(some), -1)
                rows[place[some]] = fold(x, int(w) // 8)
            held[int(w)] = place, rows
        return wide, held

    def marked(t: pa.Table) -> list[pa.RecordBatch]:
        bucket, n = (t.column(c).to_numpy() for c in ("bucket", "n"))
        wide, held = folded(t.column("middle"))
        short = [np.ascontiguousarray(c) for c in fold(held[min(held)][1], SHORT // 64).T]
        some, at, step = np.zeros(len(bucket), bool), np.arange(len(bucket)), 1
        while len(at := at[at + step < len(bucket)]):
            at = at[(bucket[at] == bucket[at + step]) & (n[at + step] * percent <= n[at] * 100)]
            one = at[~(some[at] & some[at + step])]
            gap = sum((np.bitwise_count(s[one] ^ s[one + step]).astype(np.int64) for s in short), np.zeros(len(one), np.int64))
            one = one[may_link(n[one], n[one + step], gap, percent)]
            both = np.minimum(wide[one], wide[one + step])
            for w in np.unique(both):
                place, rows = held[int(w)]
                k = one[both == w]
                gap = np.bitwise_count(rows[place[k]] ^ rows[place[k + step]]).sum(axis=1, dtype=np.int64)
                k = k[may_link(n[k], n[k + step], gap, percent)]
                some[k] = some[k + step] = True
            step += 1
        return t.select(["bucket", "node"]).filter(pa.array(some)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            bucket = held.column("bucket").to_numpy()
            # The last bucket may go on in the next batch.
            whole = int(np.argmax(bucket == bucket[-1])) if len(bucket) else 0
            if whole:
                yield from marked(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from marked(held)

    return run


def hopeful(shared: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The rows `(bucket, node)` of `shared (bucket, node, many)` that sketches allow to link with a row of their bucket.

    Most sets that share a block share a passage and little else.  They go here, before any pair is made, so
    sketches are sent once for each row of a bucket.  Buckets of more than `LOT` sets are left as they are.
    """
    sketch = classes.select("node", "n", "sketch").mapInArrow(_middle, "node long, n long, middle binary")
    some = shared.where(f"many <= {LOT}").select("bucket", "node").join(sketch, "node")
    some = some.repartition("bucket").sortWithinPartitions("bucket", "n").select("bucket", "node", "n", "middle")
    some = some.mapInArrow(_hopeful(percent), "bucket long, node long")
    return some.union(shared.where(f"many > {LOT}").select("bucket", "node"))


def small_pairs(left: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """`(a, b)`, the pairs of different components in groups `left (grp, node, comp)` of a few sets that may link."""
    rows = left.join(classes.select("node", "n", *WORDS), "node")
    one, two = (rows.toDF(x, "grp", f"c{x}", f"n{x}", *(w + x for w in WORDS)) for x in ("a", "b"))
    return one.join(two, "grp").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & possible(percent)).select("a", "b")


def tile_pairs(left: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """`(a, b)`, all pairs of different components in a group of `left (grp, node, comp)` that sketches allow to link.

    A group is cut into tiles, and each pair of tiles is the work of one key: its sketches are compared as
    matrices, and only what passes becomes a row.
    """
    sizes = left.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    rows = left.join(sizes, "grp").withColumn("tile", F.pmod(F.xxhash64("node", F.lit(31)), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    rows = rows.withColumn("other", other).select(
        "grp", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"), "tile", "node", "comp"
    )
    rows = rows.join(classes.select("node", "n", "sketch"), "node")
    dealt = rows.repartition("grp", "one", "two").sortWithinPartitions("grp", "one", "two", "n", "node")

    def compare(held: list) -> tuple[list, list]:
        first, second, out_a, out_b = {}, {}, [], []
        for tile, one, node, comp, n, sketch in held:  # by length of the sketch
            for side, wanted in ((first, tile == one[0]), (second, tile == one[1])):
                if wanted:
                    side.setdefault(len(sketch), []).append((node, comp, n, sketch))
        same = held[0][1][0] == held[0][1][1]
        stack = lambda rows: (*(np.array([r[c] for r in rows]) for c in range(3)), np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1))
        for wa, ra in first.items():
            na, ca, sa, xa = stack(ra)
            for wb, rb in second.items():
                nb, cb, sb, xb = stack(rb)
                width = min(wa, wb)
                fa, fb = (np.ascontiguousarray(fold(x, width)).view(np.uint64) for x in (xa, xb))
                for k in range(len(na)):
                    ok = (ca[k] != cb) & ((na[k] < nb) if same else True)
                    ok &= np.minimum(sa[k], sb) * 100 >= np.maximum(sa[k], sb) * percent
                    at = np.flatnonzero(ok)
                    if len(at):
                        gap = np.bitwise_count(fa[k] ^ fb[at]).sum(axis=1)
                        at = at[may_link(sa[k], sb[at], gap, percent)]
                        out_a += [int(na[k])] * len(at)
                        out_b += nb[at].tolist()
        return out_a, out_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush():
            a, b = compare(held) if held else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for grp, one, two, tile, node, comp, n, sketch in zip(*(batch.column(c).to_pylist() for c in ("grp", "one", "two", "tile", "node", "comp", "n", "sketch"))):
                if (grp, one, two) != now:
                    yield flush()
                    now, held = (grp, one, two), []
                held.append((tile, (one, two), node, comp, n, sketch))
        yield flush()

    out = dealt.mapInArrow(run, "a long, b long")
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def similarity_components(
    docs: DataFrame, percent: int = 85, width: int = WIDTH, rounds: int = 2, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`(doc_id, n_shingles, component_id)` for each row of `docs`.

    Two documents are linked if 100 * intersection >= percent * union of their sets of word n-grams;
    `component_id` is the smallest id that links reach.
    """
    scratch = Scratch(docs.sparkSession, "parity")
    texts = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("text"))
    schema = "id long, n_shingles long, digest binary, sketch binary, s0 long, s1 long, s2 long, s3 long, keys array<long>"
    rows = scratch.save(texts.mapInArrow(_prepare(width, percent), schema), "rows")
    # One row for each class of equal sets, which have equal sketches and keys; its node is the smallest id.
    classes = rows.where("n_shingles > 0").groupBy("digest")
    firsts = [F.first(c).alias(c) for c in ("sketch", *WORDS, "keys")]
    classes = scratch.save(classes.agg(F.min("id").alias("node"), F.min("n_shingles").alias("n"), *firsts), "classes")
    members = scratch.save(rows.select("id", "n_shingles", "digest"), "members")
    scratch.drop("rows")
    keys = classes.select("node", F.explode("keys").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    shared = scratch.save(keys.join(shared, "bucket"), "shared")
    classes = scratch.save(classes.drop("keys"), "sketches")
    scratch.drop("classes")
    left = scratch.save(hopeful(shared, classes, percent), "hopeful")
    scratch.drop("shared")

    def settle(pairs: DataFrame, name: str) -> DataFrame:
        """`(a, b, linked)` of the pairs that the sketches let pass."""
        passed = scratch.save(screen(pairs, classes, percent).distinct(), f"passed-{name}")
        ids = scratch.save(passed.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"ids-{name}")
        needed = scratch.save(texts.join(sent(ids), "id", "left_semi").distinct(), f"texts-{name}")
        tried = scratch.save(confirm(passed, needed, width, percent).select("a", "b", "linked"), f"tried-{name}")
        scratch.drop(f"passed-{name}", f"ids-{name}", f"texts-{name}")
        return tried

    # Rows that repeat an id are one document: the classes of its texts are joined through the id.
    often = members.groupBy("id").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("id")
    through = members.where("n_shingles > 0").join(often, "id").select("id", "digest").distinct()
    through = through.join(classes.select("digest", "node"), "digest").where("node <> id")
    through = scratch.save(through.select(F.col("node").alias("a"), F.col("id").alias("b")).distinct(), "through")

    tried, comps = None, None
    for turn in range(rounds + 2):
        if turn == 0:
            centres = left.groupBy("bucket").agg(F.min("node").alias("centre"))
            pairs = left.join(centres, "bucket").where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))
        elif turn <= rounds:
            # The next centre: a set with many links, then any set, drawn by hash in each bucket.
            ends = tried.where("linked").select(F.explode(F.array("a", "b")).alias("node")).groupBy("node")
            ranked = left.join(ends.agg(F.count(F.lit(1)).alias("links")), "node", "left")
            links = F.coalesce("links", F.lit(0)) if turn == 1 else F.lit(0)
            best = F.struct((-links).alias("links"), F.xxhash64("node", "bucket", F.lit(turn)).alias("drawn"), "node", "comp")
            centres = ranked.groupBy("bucket").agg(F.min(best).alias("c")).selectExpr("bucket", "c.node centre", "c.comp of")
            pairs = left.join(centres, "bucket").where(F.col("comp") != F.col("of"))
            pairs = pairs.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b"))
        else:
            # Buckets with the same sets are one group.
            same = [F.count(F.lit(1)).alias("many"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("y")]
            groups = left.groupBy("bucket").agg(*same).groupBy("many", "x", "y").agg(F.min("bucket").alias("bucket"))
            group = left.join(groups.select("bucket", "many"), "bucket").select(F.col("bucket").alias("grp"), "node", "comp", "many")
            group = scratch.save(group, "groups")
            few, lots = (group.where(f"many {how} {SMALL}").drop("many") for how in ("<=", ">"))
            few = few.select("node", "grp", "comp")
            pairs = small_pairs(few, classes, percent).union(tile_pairs(lots, classes, percent))
        pairs = pairs.distinct()
        if tried is None:
            tried = settle(pairs, "0")
        else:
            more = settle(pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"), str(turn))
            tried = scratch.save(tried.union(more), f"all-{turn}")
        comps = components(tried.where("linked").select("a", "b").union(through), scratch, f"linked-{turn}")
        if turn > rounds:
            break
        now = left.select("bucket", "node").join(comps.toDF("node", "comp"), "node", "left")
        now = now.withColumn("comp", F.coalesce("comp", "node"))
        mixed = now.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
        left = scratch.save(now.join(mixed.select("bucket"), "bucket"), f"open-{turn}")
        scratch.drop("hopeful", f"open-{turn - 1}")
        if left.isEmpty():
            break
    # Members of classes that are joined to others get the component of their class; all else is itself.
    of = classes.select("digest", "node").join(comps.toDF("node", "comp"), "node", "left")
    of = of.select("digest", F.coalesce("comp", "node").alias("comp"))
    out = members.where("n_shingles > 0").join(of, "digest", "left").select("id", "n_shingles", "comp")
    none = members.where("n_shingles = 0").select("id", "n_shingles").join(comps.toDF("id", "comp"), "id", "left")
    back = lambda c: F.nullif(c, F.lit(NO_ID))
    return out.unionByName(none).select(
        back(F.col("id")).alias("doc_id"), "n_shingles", back(F.coalesce("comp", "id")).alias("component_id")
    )
