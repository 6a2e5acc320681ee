"""Graph operators without SQL of their own, against small brute-force versions."""

from collections import deque

import pytest

from starloom.operators import graph

EDGES = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 5), (5, 3), (6, 6), (7, 8), (8, 7)]


@pytest.fixture
def edges(spark):
    return spark.createDataFrame(EDGES, "src bigint, dst bigint")


def bfs(s):
    d, n, q = {s: 0}, {s: 1}, deque([s])
    while q:
        x = q.popleft()
        for a, b in EDGES:
            if a == x and a != b:
                if b not in d:
                    d[b], n[b] = d[x] + 1, 0
                    q.append(b)
                if d[b] == d[x] + 1:
                    n[b] += n[x]
    return d, n


def test_betweenness(edges):
    ids = sorted({x for e in EDGES for x in e})
    all_ = {s: bfs(s) for s in ids}
    want = dict.fromkeys(ids, 0.0)
    for s in ids:
        d, n = all_[s]
        for t in d:
            for v in d:
                if len({s, t, v}) == 3 and t in all_[v][0] and d[v] + all_[v][0][t] == d[t]:
                    want[v] += n[v] * all_[v][1][t] / n[t]
    got = {r.id: r.betweenness for r in graph.betweenness(edges).collect()}
    assert got == pytest.approx(want)


def test_components(edges):
    assert {r.id: r.component for r in graph.connected_components(edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 6, 7: 7, 8: 7}
    assert {r.id: r.component for r in graph.strong_components(edges).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7, 8: 7}


def test_label_propagation_keeps_components_apart(edges):
    got = {r.id: r.community for r in graph.label_propagation(edges).collect()}
    assert got[6] == 6 and {got[7], got[8]} <= {7, 8} and all(got[i] < 6 for i in range(6))


def test_empty(spark):
    none = spark.createDataFrame([], "src bigint, dst bigint")
    for f in (graph.connected_components, graph.strong_components, graph.betweenness, graph.label_propagation, graph.pagerank, graph.closeness, graph.degree):
        assert f(none).count() == 0
