"""Graph operators against hand-made and random graphs."""

import itertools
import random
from collections import defaultdict, deque

import pytest

from skein.operators import entropy, graph, leiden
from skein.operators.components import connected_components


def edges_df(spark, edges):
    return spark.createDataFrame([(min(a, b), max(a, b), float(w)) for a, b, w in edges], "src long, dst long, weight double")


def random_edges(n, m, seed):
    r = random.Random(seed)
    return [(a, b, r.randint(1, 5)) for a, b in r.sample(list(itertools.combinations(range(n), 2)), m)]


def test_window_of_four(spark):
    toks = spark.createDataFrame([(1, i, t) for i, t in enumerate(["alpha", "beta", "gamma", "delta"])], "segment long, pos int, token string")
    got = {(r.src, r.dst): r.weight for r in graph.cooccurrence_edges(toks, ["segment"]).collect()}
    assert got == {("alpha", "beta"): 3, ("alpha", "gamma"): 2, ("alpha", "delta"): 1, ("beta", "gamma"): 3, ("beta", "delta"): 2, ("delta", "gamma"): 3}


def test_promoted_phrases(spark):
    data = [(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 1, "b"), (3, 0, "c"), (3, 1, "d"), (3, 2, "c"), (3, 3, "d")]
    found = graph.promoted_phrases(spark.createDataFrame(data, "seg long, pos int, token string"), ["seg"]).collect()
    assert sorted((r.seg, r.pos, r.a, r.b) for r in found) == [(2, 0, "a", "b"), (3, 0, "c", "d"), (3, 2, "c", "d")]


def test_components_of_chains_hubs_and_loops(spark):
    data = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 300)] + [(100, 101)] * 3
    got = dict(connected_components(spark.createDataFrame(data, "src long, dst long")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140)) and got[300] == 300
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def brute_betweenness(edges, n):
    near = defaultdict(set)
    for a, b, _ in edges:
        near[a].add(b)
        near[b].add(a)
    score = defaultdict(float)
    for s in near:
        dist, paths, order, queue = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        delta = defaultdict(float)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    delta[v] += paths[v] / paths[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    return {v: score[v] / ((n - 1) * (n - 2)) for v in near}


def test_betweenness(spark):
    edges = random_edges(14, 22, 1)
    df = edges_df(spark, edges)
    nodes = graph.both_ways(df).select("node").distinct()
    got = dict(graph.betweenness(df, nodes.withColumnRenamed("node", "source"), nodes.count()).collect())
    assert got == pytest.approx(brute_betweenness(edges, len(got)))


def test_gap_path_length(spark):
    df = edges_df(spark, [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 4, 1), (8, 9, 1)])
    members = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (8, 2), (9, 2)], "node long, community int")
    gaps = spark.createDataFrame([(0, 1), (0, 2)], "ca int, cb int")
    got = {(r.ca, r.cb): r.path_length for r in graph.gap_path_length(df, members, gaps).collect()}
    assert got == {(0, 1): pytest.approx((3 + 4 + 2 + 3 + 1 + 2) / 6), (0, 2): None}


def test_communities_find_two_cliques(spark):
    edges = [(a, b, 10) for a, b in itertools.combinations(range(5), 2)] + [(a, b, 10) for a, b in itertools.combinations(range(10, 15), 2)] + [(0, 10, 1)]
    df = edges_df(spark, edges)
    found = leiden.communities(df)
    got = dict(found.collect())
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1 and got[0] != got[10]
    q = graph.modularity(df, found).first()[0]
    assert q == pytest.approx(2 * 100 / 201 - 2 * (201 / 402) ** 2, abs=1e-9)


@pytest.mark.parametrize("n", [3, 6])
def test_complete_graph_entropy(spark, n):
    q = entropy.quadratic_entropy(edges_df(spark, [(a, b, 2) for a, b in itertools.combinations(range(n), 2)])).first()["q"]
    assert q == pytest.approx((n - 2) / (n - 1))


def test_entropy_centrality_is_removal(spark):
    edges = random_edges(12, 24, 3)

    def q(es, n):
        d = defaultdict(float)
        for a, b, w in es:
            d[a] += w
            d[b] += w
        return 1 - (n + 2 * sum(w * w / (d[a] * d[b]) for a, b, w in es)) / n**2

    nodes = {v for a, b, _ in edges for v in (a, b)}
    want = {v: q(edges, len(nodes)) - q([e for e in edges if v not in e[:2]], len(nodes) - 1) for v in nodes}
    assert dict(entropy.entropy_centrality(edges_df(spark, edges)).collect()) == pytest.approx(want)


def test_lambda_max(spark):
    import numpy as np

    edges = random_edges(12, 30, 5)
    value, _, residual = entropy.lambda_max(edges_df(spark, edges))
    nodes = sorted({v for a, b, _ in edges for v in (a, b)})
    m = np.zeros((len(nodes),) * 2)
    for a, b, w in edges:
        m[nodes.index(a), nodes.index(b)] = m[nodes.index(b), nodes.index(a)] = w
    d = m.sum(axis=0)
    laplacian = np.eye(len(nodes)) - m / np.sqrt(np.outer(d, d))
    assert value * len(nodes) == pytest.approx(np.linalg.eigvalsh(laplacian)[-1], rel=1e-6) and residual < 1e-4


def test_gap_path_length_from_more_sources_than_a_number_has_bits(spark):
    """A ring of 40 communities of two with chords: 80 sources, each pair of communities by breadth-first search."""
    n, steps = 80, (1, 9, 23)
    df = edges_df(spark, [(i, (i + s) % n, 1) for i in range(n) for s in steps])
    members = spark.createDataFrame([(i, i // 2) for i in range(n)] + [(99, 77)], "node long, community int")
    hops, queue = {0: 0}, deque([0])
    while queue:
        u = queue.popleft()
        for v in {(u + s) % n for s in steps} | {(u - s) % n for s in steps}:
            if v not in hops:
                hops[v] = hops[u] + 1
                queue.append(v)
    pairs = [(0, 1), (0, 20), (3, 39), (10, 35), (0, 77)]
    got = {(r.ca, r.cb): r.path_length for r in graph.gap_path_length(df, members, spark.createDataFrame(pairs, "ca int, cb int")).collect()}
    want = {(a, b): sum(hops[(y - x) % n] for x in (2 * a, 2 * a + 1) for y in (2 * b, 2 * b + 1)) / 4 for a, b in pairs[:-1]}
    assert got == {**{p: pytest.approx(w) for p, w in want.items()}, (0, 77): None}
