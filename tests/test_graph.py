import random

import pytest

from quarrygraph.operators import codegraph as G
from quarrygraph.operators import hierarchy as H
from quarrygraph.plans.rounds import connected_components

NAMES = "root_func caller_a caller_b caller_c callee_a callee_b callee_a1".split()
CALLS = [("caller_a", "root_func", 35), ("caller_b", "root_func", 55), ("caller_c", "caller_a", 75), ("root_func", "callee_a", 15), ("root_func", "callee_b", 16), ("callee_a", "callee_a1", 95)]


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "caller long, callee long, line int")


@pytest.fixture(scope="module")
def fixture_a(spark):
    i = {n: k + 1 for k, n in enumerate(NAMES)}
    return i, edges_of(spark, [(i[a], i[b], n) for a, b, n in CALLS]), spark.createDataFrame([(i["root_func"],)], "node long")


def test_call_graph_depth_one(fixture_a):
    _, e, root = fixture_a
    rows = G.call_graph_edges(e, root, 1).collect()
    assert sum(r["callee_depth"] == 1 for r in rows) == 2
    assert sum(r["caller_depth"] == 1 for r in rows) == 2
    assert not any(r["callee_depth"] and r["caller_depth"] for r in rows)


def test_call_graph_depth_two(spark, fixture_a):
    i, e, root = fixture_a
    ent = spark.createDataFrame([(v, k, "function", "test.c") for k, v in i.items()], "id long, symbol string, type string, filename string")
    assert G.call_graph_edges(e, root, 2).count() == 6
    nodes = G.call_graph_nodes(e, root, 2, ent).collect()
    assert len(nodes) == 7 and sum(n["is_root"] for n in nodes) == 1


def test_heatmap(spark):
    # 1 root, 2-4 branches, 5 leaf, 6 shared, 7 deep
    e = edges_of(spark, [(1, 2, 1), (1, 3, 2), (1, 4, 3), (1, 5, 4), (2, 6, 5), (3, 6, 6), (4, 6, 7), (6, 7, 8)])
    root = spark.createDataFrame([(1,)], "node long")
    heat = {r["node"]: (r["caller_count"], r["heat"]) for r in G.call_heatmap(e, root, 3).collect()}
    assert heat[6] == (3, 1.0)
    assert all(heat[n] == (1, pytest.approx(1 / 3)) for n in (1, 2, 3, 4, 5, 7))
    two = {r["node"]: r["caller_count"] for r in G.call_heatmap(e, root, 2).collect()}
    assert two[6] == 3 and 7 not in two and len(two) == 6


def test_cycle_ends_and_self_loop(spark):
    root = spark.createDataFrame([(1,)], "node long")
    e = edges_of(spark, [(1, 2, 1), (2, 3, 2), (3, 1, 3)])
    assert {(r["node"], r["dist"]) for r in G.reach(e, root, 10).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert sorted(r["depth"] for r in G.reach_edges(e, root, 10).collect()) == [1, 2, 3]
    assert G.tree_edges(edges_of(spark, [(1, 1, 1)]), root, 3).count() == 1


def test_two_calls_of_one_pair_heat_twice(spark):
    root = spark.createDataFrame([(1,)], "node long")
    heat = {r["node"]: r["caller_count"] for r in G.call_heatmap(edges_of(spark, [(1, 2, 1), (1, 2, 9)]), root, 1).collect()}
    assert heat == {1: 1, 2: 2}


def brute_forest(parent):
    out = {}
    for n in set(parent) | set(parent.values()):
        path, m = [n], n
        while m in parent and parent[m] not in path:
            m = parent[m]
            path.append(m)
        if m in parent:
            out[n] = (min(path[path.index(parent[m]) :]), -1, None)
        else:
            out[n] = (m, len(path) - 1, path[::-1])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_against_brute_force(spark, seed):
    r = random.Random(seed)
    parent = {}
    for n in range(2, 60):
        parent[n] = r.randrange(1, n)
    for a, b in ((100, 101), (101, 102), (102, 100), (103, 102), (104, 103), (200, 200)):
        parent[a] = b
    rows = [(c, p) for c, p in parent.items()] * 2 + [(None, 5), (7, None)]
    got = {x["node_id"]: (x["root_id"], x["depth"], x["path"]) for x in H.forest(spark.createDataFrame(rows, "child long, parent long")).collect()}
    assert got == brute_forest(parent)
    short = {x["node_id"]: (x["root_id"], x["depth"]) for x in H.forest(spark.createDataFrame(rows, "child long, parent long"), paths=False).collect()}
    assert short == {n: x[:2] for n, x in got.items()}


def test_subtree_sizes_and_descendants(spark):
    t = H.forest(spark.createDataFrame([(2, 1), (3, 1), (4, 2)], "child long, parent long"))
    assert {r["node_id"]: r["subtree_size"] for r in t.collect()} == {1: 4, 2: 2, 3: 1, 4: 1}
    assert {tuple(r) for r in H.descendants(t).collect()} == {(1, 2, 1), (1, 3, 1), (1, 4, 2), (2, 4, 1)}


def test_empty_hierarchies(spark):
    e = spark.createDataFrame([], "child long, parent long")
    assert H.forest(e).count() == 0
    assert H.circles(e, "child", "parent").count() == 0
    assert connected_components(e, "child", "parent").count() == 0


def brute_circles(edges):
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)

    def reach(s):
        seen, todo = set(), list(adj.get(s, ()))
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += adj.get(v, ())
        return seen

    far = {n: reach(n) for n in adj}
    return {(n, min(m for m in far[n] if n in far.get(m, ()))) for n in adj if n in far[n]}


@pytest.mark.parametrize("part_edges", [100_000, 0])
def test_circles_against_brute_force(spark, part_edges):
    r = random.Random(4)
    edges = [(r.randrange(30), r.randrange(30)) for _ in range(40)] + [(50, 51), (51, 50), (51, 52), (60, 60)]
    got = {tuple(x) for x in H.circles(spark.createDataFrame(edges + [(None, 1), (2, None)] + edges[:3], "source long, target long"), part_edges=part_edges).collect()}
    assert got == brute_circles(edges)


def test_components_of_a_long_chain(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 101)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert set(got.values()) == {0, 100} and got[40] == 0


def test_hierarchy_fixture(spark):
    # Dog and Cat extend Animal, Dog implements Runnable
    edges = spark.createDataFrame([(2, 1), (3, 1), (2, 4)], "child long, parent long")
    roles = {(r["id"], r["role"]) for r in G.roots_and_leaves(edges).collect()}
    assert roles == {(1, "root"), (4, "root"), (2, "leaf"), (3, "leaf")}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 10_000, []
    monkeypatch.setattr(H, "cut", lambda df, keep=H.cut: rounds.append(1) or keep(df))
    t = H.forest(spark.range(1, n).selectExpr("id AS child", "id - 1 AS parent"), paths=False)
    deepest = t.orderBy("node_id", ascending=False).first()
    assert (deepest["root_id"], deepest["depth"], deepest["peel_level"]) == (0, n - 1, 0)
    assert t.filter("node_id = 0").first()["subtree_size"] == n and t.filter("peel_level + depth = 9999").count() == n
    assert len(rounds) <= 16


def test_long_circles_and_tails(spark):
    # circles of 1, 2, 3, 8 and 100 nodes, each with a tail of five nodes
    rows, want = [], {}
    for at, size in ((1000, 1), (2000, 2), (3000, 3), (4000, 8), (5000, 100)):
        rows += [(at + i, at + (i + 1) % size) for i in range(size)] + [(at + 900 + i, at + 899 + i if i else at) for i in range(5)]
        want |= {x: at for x in [*range(at, at + size), *range(at + 900, at + 905)]}
    got = {r["node_id"]: (r["root_id"], r["depth"]) for r in H.forest(spark.createDataFrame(rows, "child long, parent long")).collect()}
    assert got == {k: (v, -1) for k, v in want.items()}


def test_components_beyond_a_chunk(spark, monkeypatch):
    from quarrygraph.plans import rounds

    monkeypatch.setattr(rounds, "CHUNK", 3)
    rows = [(i, i + 1) for i in range(60)] + [(100, 101), (None, 3), (5, 5)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


@pytest.mark.parametrize("part_edges", [100_000, 0])
def test_ids_may_be_texts(spark, part_edges):
    trees = H.forest(spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "x")], "child string, parent string"))
    assert {(r["node_id"], r["root_id"], r["depth"]) for r in trees.collect()} == {("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("x", "x", -1), ("y", "x", -1), ("z", "x", -1)}
    calls = spark.createDataFrame([("f", "g"), ("g", "h"), ("h", "f"), ("h", "k"), ("m", "m")], "source string, target string")
    assert {tuple(r) for r in H.circles(calls, part_edges=part_edges).collect()} == {("f", "f"), ("g", "f"), ("h", "f"), ("m", "m")}
