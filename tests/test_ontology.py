"""Paths, groups and tokens of a small hierarchy."""

import random

import pytest

from wordloom.operators import ontology as ON


@pytest.fixture(scope="module")
def hierarchy(spark):
    nodes = [
        ("r", "food material"), ("a", "plant food product"), ("b", "fruit"), ("c", "red apple juice"),
        ("d", "multi-component food"), ("e", "pie"), ("f", "root vegetable"), ("g", "only pruned below"),
        ("h", "animal food product"), ("x", "elsewhere"), ("y", "the Red  carrots 2 (raw)"),
    ]
    edges = [
        ("a", "r"), ("b", "a"), ("c", "b"), ("c", "h"), ("d", "r"), ("e", "d"), ("g", "r"), ("d", "g"),
        ("f", "a"), ("h", "r"), ("x", "unknown"), ("y", "a"), ("y", "a"),
    ]
    return (
        spark.createDataFrame(nodes, "id string, label string"),
        spark.createDataFrame(edges, "child string, parent string"),
    )


def test_leaf_paths(hierarchy):
    got = sorted((r.leaf_id, tuple(r.path)) for r in ON.leaf_paths(*hierarchy).collect())
    assert got == [
        ("c", ("food material", "animal food product", "red apple juice")),
        ("c", ("food material", "plant food product", "fruit", "red apple juice")),
        ("f", ("food material", "plant food product", "root vegetable")),
        ("y", ("food material", "plant food product", "the Red  carrots 2 (raw)")),
    ]
    assert ON.leaf_paths(*hierarchy, pruned=["food material"]).count() == 0
    assert ON.leaf_paths(*hierarchy, pruned=()).count() == 6


def test_cycle_is_an_error(spark, hierarchy):
    nodes, edges = hierarchy
    loop = edges.union(spark.createDataFrame([("a", "b")], "child string, parent string"))
    with pytest.raises(ValueError, match="cycle"):
        ON.leaf_paths(nodes, loop)


def test_cycle_out_of_reach_is_none(spark, hierarchy):
    nodes, edges = hierarchy
    more = spark.createDataFrame([("p", "one"), ("q", "two"), ("s", "self")], "id string, label string")
    loops = spark.createDataFrame([("p", "q"), ("q", "p"), ("s", "s"), ("x", "p")], "child string, parent string")
    want = sorted(map(str, ON.leaf_paths(nodes, edges).collect()))
    assert sorted(map(str, ON.leaf_paths(nodes.union(more), edges.union(loops)).collect())) == want
    # The pruned node leads to a cycle, but no path goes there.
    pruned = edges.union(loops).union(spark.createDataFrame([("p", "d")], "child string, parent string"))
    assert sorted(map(str, ON.leaf_paths(nodes.union(more), pruned).collect())) == want
    with pytest.raises(ValueError, match="cycle"):
        ON.leaf_paths(nodes.union(more), edges.union(loops).union(spark.createDataFrame([("s", "r")], "child string, parent string")))


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 1000, []
    nodes = spark.createDataFrame([(k, "food material" if k == 0 else f"n{k}") for k in range(n)], "id int, label string")
    edges = spark.createDataFrame([(k + 1, k) for k in range(n - 1)], "child int, parent int")
    cut = ON.checkpoint
    monkeypatch.setattr(ON, "checkpoint", lambda df: rounds.append(1) or cut(df))
    (row,) = ON.leaf_paths(nodes, edges).collect()
    assert row.leaf_id == n - 1 and row.path == ["food material", *(f"n{k}" for k in range(1, n))]
    assert len(rounds) <= 13


def test_random_hierarchies_against_recursion(spark):
    """Several roots, one below another, diamonds, two labels of one id, a root that is a leaf, crowded parents."""
    pick = random.Random(2)
    for turn in range(3):
        n = 40
        label = lambda k: "food material" if k in (0, 1, 9, 39) else pick.choice(["a", "b", "multi-component food", f"l{k}"])
        nodes = [(k, label(k)) for k in range(n)] + [(12, "twice"), (30, "leaf twice")]
        edges = [(k, pick.randrange(k)) for k in range(2, 39) for _ in range(pick.randrange(1, 3))] + [(5, 100), (101, 3)]
        children, labels = {}, {}
        for c, p in set(edges):
            children.setdefault(p, set()).add(c)
        for k, x in nodes:
            if x not in ON.PRUNED_LABELS:
                labels.setdefault(k, []).append(x)
        want = []

        def down(k, path, children=children, labels=labels, want=want):
            if k not in children:
                want.append((k, path))
            for c in children.get(k, ()):
                for x in labels.get(c, ()):
                    down(c, (*path, x))

        for k, x in nodes:
            if x == "food material":
                down(k, (x,))
        tables = spark.createDataFrame(nodes, "id int, label string"), spark.createDataFrame(edges, "child int, parent int")
        for crowd in (ON.CROWD, 1):
            got = [(r.leaf_id, tuple(r.path)) for r in ON.leaf_paths(*tables, crowd=crowd).collect()]
            assert sorted(got) == sorted(want) and want


def test_padding(hierarchy):
    rows = ON.pad_paths(ON.leaf_paths(*hierarchy)).collect()
    assert rows[0].__fields__ == ["leaf_id", "level_0", "level_1", "level_2", "level_3"]
    assert {r.level_3 for r in rows} == {"", "red apple juice"}


def test_groups_and_tokens(spark, hierarchy):
    groups = ON.ontology_groups(ON.leaf_paths(*hierarchy))
    assert sorted((r.grp, r.member) for r in groups.collect()) == [
        ("animal food product", "red apple juice"),
        ("plant food product", "red apple juice"),
        ("plant food product", "root vegetable"),
        ("plant food product", "the Red  carrots 2 (raw)"),
    ]
    vocab = spark.createDataFrame([(w,) for w in ["red", "appl", "juic", "carrot", "appl_juic"]], "token string")
    for rows in (100, 1):
        members = ON.group_tokens(groups, vocab, max_rows=rows)
        got = {}
        for r in members.collect():
            got.setdefault(r.grp, set()).add(r.token)
        assert got == {
            "animal food product": {"red", "appl", "juic"},
            "plant food product": {"red", "appl", "juic", "carrot"},
        }
    model = spark.createDataFrame([("appl", "juic")], "w1 string, w2 string")
    joined = ON.group_tokens(groups, vocab, model)
    assert {r.token for r in joined.where("grp = 'animal food product'").collect()} == {
        "red", "appl", "juic", "appl_juic",
    }
    asked = spark.createDataFrame([("carrot",), ("none",)], "token string")
    pairs = ON.similar_tokens(members, asked).collect()
    assert sorted((r.token, r.neighbour) for r in pairs) == [
        ("carrot", "appl"), ("carrot", "juic"), ("carrot", "red"),
    ]
