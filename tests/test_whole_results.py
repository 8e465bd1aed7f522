"""Operators without SQL against plain Python and numpy, on several groups or random graphs."""

import itertools
import random
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import audit, entropy, graph, leiden, sheaf, vectors


def edges_df(spark, edges):
    return spark.createDataFrame([(min(a, b), max(a, b), float(w)) for a, b, w in edges], "src long, dst long, weight double")


def grouped(spark, seed, sizes, dimension=5):
    rng = np.random.default_rng(seed)
    groups = {f"g{k}": rng.normal(size=(n, dimension)) * rng.uniform(0.2, 4, dimension) for k, n in enumerate(sizes)}
    rows = [(g, i, v.tolist(), i % 4) for g, x in groups.items() for i, v in enumerate(x)]
    return groups, spark.createDataFrame(rows, "g string, id int, v array<double>, tokens int")


def spectral_entropy(x):
    p = np.linalg.eigvalsh(x.T @ x / len(x))
    p = p[p > 1e-12] / p.sum()
    return -(p * np.log(p)).sum()


def test_profile_of_groups(spark):
    groups, df = grouped(spark, 3, [7, 12, 40, 25])
    got = {r.g: r for r in audit.entropy_profile(df, "g", "v", "tokens").collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        assert got[g].entropy == pytest.approx(spectral_entropy(x), abs=1e-9)
        assert got[g].centroid == pytest.approx(x.mean(axis=0))
        assert (got[g].n, got[g].tokens) == (len(x), sum(i % 4 for i in range(len(x))))


def test_directions_of_groups(spark):
    groups, df = grouped(spark, 4, [9, 30, 16])
    found = defaultdict(dict)
    for r in vectors.concept_subspace(df, "g", "v", 3).collect():
        found[r.g][r["rank"]] = np.array(r.direction)
    assert set(found) == set(groups)
    for g, x in groups.items():
        want = np.linalg.svd(x - x.mean(axis=0))[2][:3]
        got = np.array([found[g][k] for k in sorted(found[g])])
        assert np.abs((got * want).sum(axis=1)) == pytest.approx([1, 1, 1])


def test_graph_entropy(spark):
    r = random.Random(1)
    edges = [(a, b, r.randint(1, 5)) for a, b in r.sample(list(itertools.combinations(range(11), 2)), 26)]
    nodes = sorted({v for a, b, _ in edges for v in (a, b)})
    n, m = len(nodes), np.zeros((len(nodes),) * 2)
    for a, b, w in edges:
        m[nodes.index(a), nodes.index(b)] = m[nodes.index(b), nodes.index(a)] = w
    d = m.sum(axis=0)
    top = np.linalg.eigvalsh(np.eye(n) - m / np.sqrt(np.outer(d, d)))[-1] / n
    q = 1 - (n + sum((m / np.outer(d, d) * m).ravel())) / n**2
    got = entropy.graph_entropy(edges_df(spark, edges)).first()
    assert got["lambda"] == pytest.approx(top, rel=1e-6)
    assert got["q"] == pytest.approx(q) and got["n"] == n
    assert got["entropy"] == pytest.approx(-got["q"] * np.log(got["lambda"]))
    assert got["converged"] and got["residual"] < 1e-4


def test_graph_entropy_without_edges(spark):
    got = entropy.graph_entropy(edges_df(spark, [(0, 1, 1)]).where("false")).first()
    assert (got["lambda"], got["entropy"], got["rounds"], got["converged"]) == (0, 0, 0, True)


@pytest.mark.parametrize("seed", [1, 2])
def test_gap_path_length_on_random_graphs(spark, seed):
    r = random.Random(seed)
    edges = [(a, b, 1) for a, b in r.sample(list(itertools.combinations(range(30), 2)), 36)]
    near = defaultdict(set)
    for a, b, _ in edges:
        near[a].add(b)
        near[b].add(a)
    part = {v: v % 4 for v in near}

    def mean(ca, cb):
        hops = []
        for s in sorted(v for v in part if part[v] == ca)[:3]:
            dist, queue = {s: 0}, deque([s])
            while queue:
                v = queue.popleft()
                for w in near[v] - set(dist):
                    dist[w] = dist[v] + 1
                    queue.append(w)
            hops += [dist[v] for v in dist if part[v] == cb]
        return pytest.approx(sum(hops) / len(hops)) if hops else None

    pairs = list(itertools.combinations(sorted(set(part.values())), 2))
    members = spark.createDataFrame(list(part.items()), "node long, community int")
    got = graph.gap_path_length(edges_df(spark, edges), members, spark.createDataFrame(pairs, "ca int, cb int")).collect()
    assert {(x.ca, x.cb): x.path_length for x in got} == {p: mean(*p) for p in pairs}


def test_communities_reach_the_planted_modularity(spark):
    r = random.Random(1)
    edges = [(a, b, r.randint(2, 4)) for k in range(4) for a, b in itertools.combinations(range(7 * k, 7 * k + 7), 2)]
    edges += [(r.randrange(7 * j, 7 * j + 7), r.randrange(7 * k, 7 * k + 7), 1) for j, k in itertools.combinations(range(4), 2) for _ in range(2)]
    df = edges_df(spark, edges).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    planted = spark.range(28).select(F.col("id").alias("node"), F.expr("id div 7").alias("community"))
    assert graph.modularity(df, leiden.communities(df)).first()[0] >= graph.modularity(df, planted).first()[0] - 1e-9


def test_consensus_to_the_tolerance(spark):
    restrictions = [("e", "source", "a", 0, 0, 1.0), ("e", "target", "b", 0, 0, 1.0)]
    b = sheaf.coboundary(spark.createDataFrame(restrictions, "edge string, side string, vertex string, r int, c int, value double"))
    x = b.select("col").distinct().withColumn("x", F.when(F.col("col.vertex") == "a", 3.0).otherwise(-1.0))
    laplacian = sheaf.sheaf_laplacian(b)
    alpha = sheaf.step_size(laplacian, x)
    assert alpha == pytest.approx(0.25)
    assert [r.x for r in sheaf.diffuse(laplacian, x, alpha, 1000).collect()] == pytest.approx([1, 1], abs=1e-7)
