"""Golden micro-graphs, invariants and metamorphic checks of the engine."""

import random

import pytest

from vertexloom import Graph
from vertexloom import algorithms as alg
from vertexloom.operators import verify

#: name: (V, edges, ranks, distances, labels, rounds of PageRank / distances / labels)
GOLDEN = {
    "diamond_tail": (6, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)], [0.15, 0.21375, 0.21375, 0.513375, 0.436369, 0], [0, 1, 1, 2, 3, None], [0, 0, 0, 0, 0, 5], (4, 4, 4)),
    "rev": (4, [(3, 2), (2, 1), (1, 0)], [0.327994, 0.385875, 0.2775, 0.15], [0, None, None, None], [0, 1, 2, 3], (4, 1, 1)),
    "loop_multi": (3, [(0, 0), (0, 1), (0, 1), (1, 2)], [0.209302, 0.268604, 0.228313], [0, 1, 2], [0, 0, 0], (11, 3, 3)),
}


def graph(spark, n, edges):
    return Graph.from_edges(spark.createDataFrame(edges, "src long, dst long"), n=n)


def column(result, name):
    return [r[name] for r in result.state.orderBy("id").collect()]


@pytest.mark.parametrize("name", list(GOLDEN))
def test_golden(spark, name):
    n, edges, ranks, dist, labels, rounds = GOLDEN[name]
    g = graph(spark, n, edges)
    pr, sp, cc = alg.pagerank(g), alg.shortest_paths(g), alg.components(g, symmetrize=False)
    assert column(pr, "rank") == pytest.approx(ranks, abs=1e-6)
    assert column(sp, "dist") == dist
    assert column(cc, "label") == labels
    assert (pr.iterations, sp.iterations, cc.iterations) == rounds


def test_empty_edges(spark):
    g = graph(spark, 3, [])
    run = alg.pagerank(g)
    assert column(run, "rank") == [0, 0, 0]
    assert run.iterations == 1


def test_random_against_model_and_hubs(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(30), rnd.randrange(30)) for _ in range(60)] + [(0, rnd.randrange(30)) for _ in range(40)]
    dist, front = {0: 0}, [0]
    while front:
        front = _step(front, edges, dist)
    g = graph(spark, 30, edges)
    want = [dist.get(i) for i in range(30)]
    for how in ({}, {"partitions": 3}, {"hub_degree": 5, "partitions": 2}, {"hub_degree": 1, "partitions": 3, "hub_bytes": 0}, {"join": "broadcast"}, {"join": "shuffle"}):
        assert column(alg.shortest_paths(g, **how), "dist") == want


def _step(front, edges, dist):
    level = dist[front[0]] + 1
    new = sorted({d for s, d in edges if s in set(front)} - set(dist))
    dist.update(dict.fromkeys(new, level))
    return new


def test_converged_identity_and_duplicate_edges(spark):
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (4, 0)]
    one = {r["id"]: r for r in alg.pagerank(graph(spark, 5, edges)).state.collect()}
    two = {r["id"]: r for r in alg.pagerank(graph(spark, 5, edges * 2)).state.collect()}
    for v, r in one.items():
        pushed = sum(one[s]["rank"] / one[s]["degree"] for s, d in edges if d == v)
        assert r["rank"] + r["residual"] == pytest.approx((0.15 if r["degree"] else 0) + 0.85 * pushed, abs=1e-9)
        assert two[v]["rank"] == pytest.approx(r["rank"], abs=1e-9)
        assert two[v]["degree"] == 2 * r["degree"]


def test_verify_and_float(spark):
    g = graph(spark, 6, GOLDEN["diamond_tail"][1])
    assert verify.distance_errors(g.edges, alg.shortest_paths(g).state).first()["errors"] == 0
    assert verify.component_errors(g.symmetrize().edges, alg.components(g).state).first()["errors"] == 0
    assert column(alg.pagerank(g, precision="float"), "rank") == pytest.approx(GOLDEN["diamond_tail"][2], abs=1e-5)
    weighted = Graph.from_edges(spark.createDataFrame([(0, 1, 5), (0, 2, 1), (2, 1, 1)], "src long, dst long, weight long"), n=3)
    assert column(alg.shortest_paths(weighted, weighted=True), "dist") == [0, 2, 1]
