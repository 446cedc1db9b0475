import numpy as np
import pytest

from folioscope.operators import graph


def reach_themselves(edges):
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    out = set()
    for node in ahead:
        seen, todo = set(), [node]
        while todo:
            for b in ahead.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        if node in seen:
            out.add(node)
    return sorted(out)


def found(spark, edges, kind="int"):
    return sorted(r.node for r in graph.cyclic_nodes(spark.createDataFrame(edges, f"a {kind}, b {kind}")).collect())


@pytest.fixture(params=["all edges at once", "by rounds"])
def few(request, monkeypatch):
    if request.param == "by rounds":
        monkeypatch.setattr(graph, "FEW_EDGES", 4)


def test_cyclic_nodes_of_a_random_graph(spark, few):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 40, (50, 2))] + [(100, 100), (101, 100), (100, 102), (102, 103), (103, 102), (None, 1)]
    assert found(spark, edges) == reach_themselves([e for e in edges if None not in e])


def test_rings_through_one_node_take_rows_as_edges_do(spark, monkeypatch, few):
    edges = [(x, y) for k in range(200) for x, y in (("hub", f"a{k}"), (f"a{k}", f"b{k}"), (f"b{k}", "hub"))] + [("hub", "out")]
    longest, kept = [], graph.cut

    def cut(df):
        out = kept(df)
        longest.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", cut)
    assert found(spark, edges, "string") == sorted({x for x, _ in edges})
    assert max(longest) <= 2 * len(edges)


def test_no_cycles(spark):
    assert found(spark, [(1, 2), (2, 3)]) == [] == found(spark, [])


def test_walk():
    ring = [(i, (i + 1) % 3000) for i in range(3000)]
    assert sorted(graph._in_cycles([*ring, (5, 9000), (9001, 5)])) == list(range(3000))
    for seed in range(20):
        edges = [(int(a), int(b)) for a, b in np.random.default_rng(seed).integers(0, 30, (35, 2))]
        assert sorted(graph._in_cycles(edges)) == reach_themselves(edges)
