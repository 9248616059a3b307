"""Training, de-noising and retrofitting against NumPy."""

import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from wordloom.functions import vectors as V
from wordloom.operators import denoise as DN
from wordloom.operators import glove as G
from wordloom.operators import retrofit as R
from wordloom.operators.groups import pairs_in_groups
from wordloom.operators import strata as ST
from wordloom.runtime import checkpoint_folder


@pytest.fixture(scope="module")
def matrix():
    return np.random.default_rng(0).normal(size=(40, 6)) + 0.7


@pytest.fixture(scope="module")
def given(spark, matrix):
    rows = [(f"w{i}", [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "token string, vec array<double>").repartition(3)


def as_dict(df):
    return {r.token: np.array(r.vec) for r in df.collect()}


def test_gram_and_denoise(given, matrix):
    gram = np.array([r.row for r in DN.gram_matrix(given).orderBy("i").collect()])
    assert np.allclose(gram, matrix.T @ matrix)
    _, s, vt = np.linalg.svd(matrix, full_matrices=False)
    expected = matrix.copy()
    share = s[:3] ** 2 / (s[:3] ** 2).sum()
    for k in range(3):
        expected -= share[k] * np.outer(expected @ vt[k], vt[k])
    got = as_dict(DN.denoise(given, 3))
    assert np.allclose([got[f"w{i}"] for i in range(40)], expected)
    # what is orthogonal to the components stays
    assert np.allclose(np.array([got[f"w{i}"] for i in range(40)]) @ vt[3:].T, matrix @ vt[3:].T)
    assert DN.denoise(given, 0) is given


def test_lookup(spark, given):
    asked = spark.createDataFrame([("w3",), ("nope",), ("w3",)], "token string")
    assert [r.token for r in DN.lookup_vectors(given, asked).collect()] == ["w3"]


def fixed_point(matrix, neighbours, alpha=0.5, beta=0.5):
    """Word after word in order, until nothing moves."""
    v = matrix.copy()
    for _ in range(500):
        for i, ns in neighbours.items():
            if ns:
                v[i] = (alpha * matrix[i] + beta * v[sorted(ns)].sum(0)) / (alpha + beta * len(ns))
    return v


def random_groups(seed, groups, words):
    rng = random.Random(seed)
    out = [(f"g{g}", f"w{w}") for g in range(groups) for w in range(words) if rng.random() < 0.15]
    return out + [("g0", "w0"), ("g0", "unknown"), ("alone", "w39")]


def neighbours_of(members):
    groups = {}
    for g, w in members:
        groups.setdefault(g, set()).add(w)
    out = {f"w{i}": set() for i in range(40)}
    for ws in groups.values():
        for w in ws & set(out):
            out[w] |= ws - {w}
    return out


@pytest.mark.parametrize("small", [0, 5, 1000])
def test_retrofit_over_overlapping_groups(spark, given, matrix, small):
    members = random_groups(3, 6, 36)
    known = {int(w[1:]): {int(n[1:]) for n in ns if n != "unknown"} for w, ns in neighbours_of(members).items()}
    expected = fixed_point(matrix, known, 4.0, 0.2)
    df = spark.createDataFrame(members, "grp string, token string")
    moves = []
    done = R.retrofit(
        given,
        R.sums_from_groups(df, small),
        alpha=4.0,
        beta=0.2,
        convergence_threshold=1e-6,
        on_iteration=lambda i, m: moves.append(m),
    )
    got = as_dict(done)
    assert np.allclose([got[f"w{i}"] for i in range(40)], expected, atol=1e-4)
    assert moves[-1] < 1e-6 < moves[0]
    assert np.allclose(got["w39"], matrix[39])  # a group of one: no neighbours


@pytest.mark.parametrize("small", [0, 5, 1000])
def test_count_neighbours(spark, small):
    members = random_groups(4, 8, 38)
    expected = {w: len(ns) for w, ns in neighbours_of(members).items() if any(w == m for _, m in members)}
    got = {r.token: r.n for r in R.count_neighbours(spark.createDataFrame(members, "grp string, token string"), small).collect()}
    assert {w: n for w, n in got.items() if w != "unknown"} == expected


def test_count_neighbours_makes_each_pair_once(spark, monkeypatch):
    """Groups of forty that share few members: counted by pairs, without a pair of atoms for each two words."""
    met = []
    monkeypatch.setattr(R, "pairs_in_groups", lambda spans: met.append(spans.count()) or pairs_in_groups(spans))
    rows = [(f"g{g}", f"w{(g * 31 + k * 7) % 300}") for g in range(40) for k in range(40)] + [("all", f"w{k}") for k in range(300)]
    held = {}
    for g, w in rows:
        held.setdefault(g, set()).add(w)
    want = {w: len(set().union(*(ms for ms in held.values() if w in ms))) - 1 for _, w in rows}
    df = spark.createDataFrame([*rows, ("g0", None), (None, "w1"), (None, "alone")], "grp string, token string")
    got = {r.token: r.n for r in R.count_neighbours(df).collect()}
    assert got == {**want, "alone": 0, None: 0} and met == [1]


def test_retrofit_over_edges(spark, given, matrix):
    edges = [("w0", "w1"), ("w1", "w0"), ("w1", "w2"), ("w2", "w1"), ("w5", "unknown"), ("w0", "w1")]
    df = spark.createDataFrame(edges, "token string, neighbour string")
    expected = fixed_point(matrix, {0: {1}, 1: {0, 2}, 2: {1}}, 4.0, 0.2)
    got = as_dict(R.retrofit(given, df, alpha=4.0, beta=0.2, convergence_threshold=1e-7))
    assert np.allclose([got[f"w{i}"] for i in range(40)], expected, atol=1e-5)
    none = R.retrofit(given, df.limit(0))
    assert np.allclose([as_dict(none)[f"w{i}"] for i in range(40)], matrix)


def test_retrofit_over_crowded_words(spark, given, matrix, monkeypatch):
    """Stars in both directions, whose edges are dealt over parts; edges with null, repeated and unknown words."""
    monkeypatch.setattr(R, "EDGES_PER_PART", 4)
    hub = [(f"w{i}", "w0") for i in range(1, 40)] + [("w0", f"w{i}") for i in range(1, 40)] + [("w3", "w4")]
    edges = [*hub, *hub[:9], ("w5", None), (None, "w5"), (None, None), ("w6", "unknown"), ("unknown", "w0")]
    df = spark.createDataFrame([(*e, 1) for e in edges], "token string, neighbour string, part int")
    neighbours = {0: set(range(1, 40))} | {i: {0} for i in range(1, 40)} | {3: {0, 4}}
    got = as_dict(R.retrofit(given, df, convergence_threshold=1e-8))
    assert np.allclose([got[f"w{i}"] for i in range(40)], fixed_point(matrix, neighbours), atol=1e-6)
    laid, crowded = R.lay_out_edges(df)
    assert [tuple(r) for r in crowded.collect()] == [("w0", 10)]
    held = {(r.neighbour, r.part): r["count"] for r in laid.groupBy("neighbour", "part").count().collect()}
    assert len([k for k in held if k[0] == "w0"]) > 5 and sum(held.values()) == len(set(hub)) + 2
    assert max(held.values()) < 12


def test_edges_are_not_shuffled_in_a_round(spark, given):
    """A round moves the vectors to the edges: one exchange for them and one for the sums."""
    edges = spark.createDataFrame([(f"w{i}", f"w{i * 7 % 40}") for i in range(40)], "token string, neighbour string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = R.sums_from_edges(edges)(given)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(30, 4))
    x = np.exp(a @ a.T / 2)
    rows = [(i, j, float(x[i, j])) for i in range(30) for j in range(30) if (i * j) % 3]
    return spark.createDataFrame(rows, "wi int, wj int, x double")


def test_glove_is_repeatable_and_releases_its_checkpoints(spark, pairs, monkeypatch):
    monkeypatch.setattr(ST, "grid_side", lambda n, cores: 3)
    folder = Path(checkpoint_folder(spark).removeprefix("file:"))
    before, costs = set(folder.rglob("rdd-*")), []
    params = ST.train_glove(pairs, dim=4, iterations=12, eta=0.2, seed=3, on_iteration=lambda i, c: costs.append((i, c)))
    again = ST.train_glove(pairs.repartition(5), dim=4, iterations=12, eta=0.2, seed=3)
    one, two = ({r.word_id: (r.vec, r.context_vec) for r in p.collect()} for p in (params, again))
    assert one == two and len(one[1][0]) == len(one[1][1]) == 5
    assert [i for i, _ in costs] == list(range(1, 13)) and costs[-1][1] < 0.5 * costs[0][1]
    assert len(set(folder.rglob("rdd-*")) - before) == 2  # the last state of each of the two runs
    with pytest.raises(ValueError):
        ST.train_glove(pairs.limit(0))


def plain_adagrad(pairs, start, eta, passes, order=None):
    """One pair after the other; `start` maps (kind, word) to vector and bias, and is changed."""
    squares = {k: np.ones_like(v) for k, v in start.items()}
    for _ in range(passes):
        for i, j, x in order() if order else pairs:
            w, c = start[0, i], start[1, j]
            slope = min(1.0, (x / 100) ** 0.75) * (w[:-1] @ c[:-1] + w[-1] + c[-1] - math.log(x))
            steps = [eta * np.clip(slope * np.append(v[:-1], 1.0), -ST.CLIP, ST.CLIP) for v in (c, w)]
            for key, g in zip(((0, i), (1, j)), steps):
                start[key] = start[key] - g / np.sqrt(squares[key])
                squares[key] = squares[key] + g * g
    return start


def starting(words, contexts, dim, seed):
    both = ((0, words), (1, contexts))
    return {(kind, k): v for kind, ids in both for k, v in zip(ids, ST.starting_values(kind, np.array(ids), dim, seed))}


def test_block_equals_one_pair_after_the_other():
    """The batches of a block change what a plain loop over the same order changes, clipped pairs included."""
    random_ = np.random.default_rng(4)
    cells = random_.choice(20 * 33, 300, replace=False)
    i, j, x = cells // 33, cells % 33, np.exp(random_.normal(2, 2, 300))
    x[:5] = 1e40
    start = starting(range(20), range(33), 3, 9)
    w, c = (ST._packed(k, np.array([start[k, m] for m in range(n)])) for k, n in ((0, 20), (1, 33)))
    args = i, j, np.log(x).astype(np.float32), np.minimum(1, (x / 100) ** 0.75).astype(np.float32)
    w, c, costs = ST.train_block(w, c, *args, 0.5, 2, np.random.default_rng(7))
    again = np.random.default_rng(7)
    parts = ST.batches_of(i, j, 20, 33, again)
    assert all(len(set(i[p])) == len(set(j[p])) == len(p) for p in parts) and sorted(np.concatenate(parts)) == list(range(300))
    order = lambda: [(int(i[m]), int(j[m]), float(x[m])) for k in again.permutation(len(parts)) for m in parts[k]]
    plain = plain_adagrad(None, start, 0.5, 2, order)
    assert np.allclose(w[:, :4], [plain[0, k] for k in range(20)], atol=1e-3, rtol=1e-3)
    assert np.allclose(c[:, [0, 1, 2, 4]], [plain[1, k] for k in range(33)], atol=1e-3, rtol=1e-3)
    assert (w[:, 4] == 1).all() and (c[:, 3] == 1).all() and len(costs) == 2


@pytest.mark.parametrize("side", [1, 4])
def test_glove_gets_as_far_as_a_plain_run(pairs, side, monkeypatch):
    monkeypatch.setattr(ST, "grid_side", lambda n, cores: side)
    rows = [(r.wi, r.wj, r.x) for r in pairs.collect()]
    pick = random.Random(1)
    start = starting(range(30), range(30), 8, 5)
    plain = plain_adagrad(None, start, 0.05, 5, lambda: pick.sample(rows, len(rows)))
    cost = sum(min(1.0, (x / 100) ** 0.75) * (plain[0, i][:-1] @ plain[1, j][:-1] + plain[0, i][-1] + plain[1, j][-1] - math.log(x)) ** 2 for i, j, x in rows)
    got = G.glove_loss(pairs, ST.train_glove(pairs, dim=8, iterations=5, seed=5)).first()
    assert got.n_pairs == len(rows) and got.loss < 1.2 * cost


def test_glove_loss_over_several_shards(pairs, monkeypatch):
    monkeypatch.setattr(G, "PAIRS_PER_SHARD", 60)
    params = ST.train_glove(pairs, dim=3, iterations=1, seed=9)
    at = {r.word_id: (np.array(r.vec), np.array(r.context_vec)) for r in params.collect()}
    loss = 0.0
    for r in pairs.collect():
        w, c = at[r.wi][0], at[r.wj][1]
        loss += min(1.0, (r.x / 100) ** 0.75) * (w[:3] @ c[:3] + w[3] + c[3] - math.log(r.x)) ** 2
    assert G.glove_loss(pairs, params).first().loss == pytest.approx(loss)


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    row = df.select(
        V.norm(a).alias("norm"),
        V.project_out(a, b, 0.5).alias("out"),
        V.combine(a, b, 0).alias("m0"),
        V.combine(a, b, 2).alias("m2"),
        V.combine(a, b, 3).alias("m3"),
    ).first()
    assert (row.norm, row.out, row.m0, row.m2, row.m3) == (5.0, [1.5, 4.0], [3, 4, 1, 0], [4.0], [3.0, 1.0])
    with pytest.raises(ValueError):
        V.combine(a, b, 4)


def test_glove_loss_keeps_no_copy_of_the_pairs(spark, pairs, monkeypatch):
    kept, written = spark.sparkContext._jsc.getPersistentRDDs(), []
    before = len(kept)
    plain = G.write_stage
    monkeypatch.setattr(G, "write_stage", lambda df: written.append(plain(df)) or written[-1])
    some = spark.createDataFrame([(k, [0.1 * k, 0.5]) for k in range(3)], "word_id long, vec array<double>")
    got = G.glove_loss(pairs, some.withColumn("context_vec", F.col("vec"))).first()
    assert got.n_pairs == pairs.where("x > 0 AND wi < 3 AND wj < 3").count()
    assert len(written) == 1 and all(f.endswith(".parquet") for f in written[0].inputFiles())
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_glove_loss_takes_its_shards_in_turns(spark, pairs, monkeypatch):
    """What is sent in a turn is small and packed, scratch tables go, and words without parameters do not count."""
    monkeypatch.setattr(G, "PAIRS_PER_SHARD", 20)
    monkeypatch.setattr(G, "SHARDS_AT_A_TIME", 0.5)
    turns, plain = [], G._costs
    monkeypatch.setattr(G, "_costs", lambda *given: turns.append(given) or plain(*given))
    folder = Path(checkpoint_folder(spark).removeprefix("file:"))
    before = sorted(folder.iterdir())
    rng = np.random.default_rng(3)
    ids = sorted({r[c] for r in pairs.select("wi", "wj").collect() for c in (0, 1)})
    w, c = ({i: rng.normal(size=5).tolist() for i in ids} for _ in range(2))
    given = lambda: spark.createDataFrame([(i, w[i], c[i]) for i in ids[:-1]], "word_id long, vec array<double>, context_vec array<double>")
    got = G.glove_loss(pairs, given()).first()
    rows = [r for r in pairs.where("x > 0").collect() if ids[-1] not in (r.wi, r.wj)]
    cost = lambda a, b, x: min(1.0, (x / 100) ** 0.75) * (np.dot(a[:-1], b[:-1]) + a[-1] + b[-1] - np.log(x)) ** 2
    assert got.n_pairs == len(rows) > 0
    assert got.loss == pytest.approx(sum(cost(w[r.wi], c[r.wj], r.x) for r in rows))
    assert len(turns) > 2
    assert sorted(folder.iterdir()) == before
    for bad in (None, [1.0, 2.0]):
        c[rows[0].wj] = bad
        with pytest.raises(PythonException):
            G.glove_loss(pairs, given())


@pytest.mark.parametrize("small", [256, 6])
def test_neighbours_are_counted_in_turns(spark, monkeypatch, small):
    """Pairs of different turns are added up; nulls, repeated rows and words that are alone stay as they are."""
    monkeypatch.setattr(R, "PAIRS_AT_A_TIME", 30)
    rng = random.Random(8)
    rows = [(f"g{rng.randrange(12)}", rng.randrange(40)) for _ in range(110)] + [("alone", 99), ("alone", None), (None, 5), (None, 98)]
    written, plain = [], R.write_stage
    monkeypatch.setattr(R, "write_stage", lambda df: written.append(plain(df)) or written[-1])
    got = {r.token: r.n for r in R.count_neighbours(spark.createDataFrame(rows + rows[:9], "grp string, token int"), small).collect()}
    want = {t: set() for _, t in rows}
    for g, t in rows:
        want[t] |= {u for h, u in rows if g is not None and g == h and u != t and None not in (t, u)}
    assert {t: n for t, n in got.items() if t is not None} == {t: len(near) for t, near in want.items() if t is not None}
    assert len(written) > 1
