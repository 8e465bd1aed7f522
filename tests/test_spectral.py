"""Lanczos and conjugate gradients against dense matrices."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import sheaf
from skein.operators.spectral import entries, largest_eigenvalue, nearest_in_kernel
from skein.operators.storage import shared_dir


def table(spark, m):
    rows = [(i, j, float(m[i, j])) for i, j in itertools.product(range(len(m)), repeat=2) if m[i, j]]
    return spark.createDataFrame(rows, "i long, j long, v double")


def vector(spark, x):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double")


@pytest.mark.parametrize("seed", [1, 2])
def test_largest_eigenvalue(spark, seed):
    r = np.random.default_rng(seed)
    b = r.normal(size=(15, 10))
    m, x = b.T @ b, r.normal(size=10)
    value, steps, residual = largest_eigenvalue(entries(table(spark, m), "i", "j", "v", "i"), vector(spark, x), "i", 1e-6)
    assert value == pytest.approx(np.linalg.eigvalsh(m)[-1], rel=1e-9) and steps <= 12 and residual < 1e-6


def test_largest_eigenvalue_of_nothing(spark):
    zero = entries(table(spark, np.eye(2)).where("false"), "i", "j", "v", "i")
    assert largest_eigenvalue(zero, vector(spark, [1, 2]), "i")[0] == 0
    assert largest_eigenvalue(zero, vector(spark, [1, 2]).where("false"), "i") == (0.0, 0, 0.0)
    with pytest.raises(RuntimeError):
        largest_eigenvalue(entries(table(spark, np.diag([1.0, 0.999, 0.99, 0.9])), "i", "j", "v", "i"), vector(spark, [1, 1, 1, 1]), "i", 1e-9, most=2)


@pytest.mark.parametrize("seed", [3, 4])
def test_nearest_in_kernel(spark, seed):
    r = np.random.default_rng(seed)
    b = r.normal(size=(6, 9))  # a kernel of three dimensions
    m, x = b.T @ b, r.normal(size=9)
    found, steps, size = nearest_in_kernel(entries(table(spark, m), "i", "j", "v", "i"), vector(spark, x), "i")
    want = x - np.linalg.pinv(b) @ b @ x
    got = {r_.i: r_.x for r_ in found.collect()}
    assert [got[i] for i in range(9)] == pytest.approx(want, abs=1e-8) and size < 1e-8 and steps <= 20


def test_consensus_of_random_sheaves(spark):
    """Stalks of two numbers, maps of one row: the projection onto the kernel, and where diffusion ends."""
    r = random.Random(9)
    rows = []
    for e, (a, b) in enumerate(itertools.combinations("abcd", 2)):
        for side, v in (("source", a), ("target", b)):
            rows += [(f"e{e}", side, v, 0, c, float(r.randint(-2, 2) or 1)) for c in (0, 1)]
    b = sheaf.coboundary(spark.createDataFrame(rows, "edge string, side string, vertex string, r int, c int, value double"))
    start = b.select("col").distinct().withColumn("x", F.ascii("col.vertex") * 0.1 + F.col("col.c"))
    at = {k: i for i, k in enumerate(sorted((x.col.vertex, x.col.c) for x in start.collect()))}
    edges = {k: i for i, k in enumerate(sorted({x.row.edge for x in b.collect()}))}
    m, x0 = np.zeros((len(edges), len(at))), np.zeros(len(at))
    for x in b.collect():
        m[edges[x.row.edge], at[x.col.vertex, x.col.c]] = x.value
    for x in start.collect():
        x0[at[x.col.vertex, x.col.c]] = x.x
    found, _, size = sheaf.consensus(sheaf.sheaf_laplacian(b), start)
    got = {(x.col.vertex, x.col.c): x.x for x in found.collect()}
    assert [got[k] for k in at] == pytest.approx(x0 - np.linalg.pinv(m) @ m @ x0, abs=1e-7) and size < 1e-8
    assert sheaf.step_size(sheaf.sheaf_laplacian(b), start) == pytest.approx(0.5 / np.linalg.eigvalsh(m.T @ m)[-1], rel=1e-4)


def test_a_shared_folder_is_asked_for_on_clusters():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        _skein_dir = None

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_kernel_of_a_large_matrix_is_reached(spark):
    """Residuals of such numbers never come below 1e-8."""
    n = 40
    m = 3e9 * (n * np.eye(n) - 1 + np.diag(np.zeros(n)))
    x = np.random.default_rng(2).normal(size=n) * 1e3
    found, steps, size = nearest_in_kernel(entries(table(spark, m), "i", "j", "v", "i"), vector(spark, x), "i", most=20)
    assert [r.x for r in found.collect()] == pytest.approx([x.mean()] * n, rel=1e-9) and steps <= 20


def test_repeated_edges_change_no_consensus(spark):
    """Edges of a star repeated 1 to 10,000 times: as many steps as without, and the same point."""
    f = {"a": 1.0, "b": 1.5, "c": 2.0, "d": 1.1}
    rows = lambda times: [(f"{v}{k}", s, u, 0, 0, f[u]) for v in "bcd" for k in range(times[v]) for s, u in (("source", v), ("target", "a"))]
    kind = "edge string, side string, vertex string, r int, c int, value double"
    once = sheaf.coboundary(spark.createDataFrame(rows({v: 1 for v in "bcd"}), kind))
    many = sheaf.distinct_rows(sheaf.coboundary(spark.createDataFrame(rows({"b": 1, "c": 100, "d": 10000}), kind)))
    assert many.count() == once.count() == 6
    point = lambda b: {r.col.vertex: r.x for r in sheaf.consensus(sheaf.sheaf_laplacian(b), b.select("col").distinct().withColumn("x", F.ascii("col.vertex") * 1.0))[0].collect()}
    assert point(many) == pytest.approx(point(once), abs=1e-7)


def test_two_sides_take_no_step(spark):
    from skein.operators.entropy import graph_entropy, lambda_max

    rng = np.random.default_rng(3)
    edges = [(a, 100 + b, float(rng.integers(1, 9))) for a in range(8) for b in range(6) if rng.random() < 0.6]
    w = np.zeros((120, 120))
    for a, b, x in edges:
        w[a, b] = w[b, a] = x
    w = w[:, (w > 0).any(0)][(w > 0).any(1)]
    root = np.sqrt(np.outer(w.sum(0), w.sum(0)))
    top = np.linalg.eigvalsh(np.eye(len(w)) - w / root)[-1] / len(w)
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    value, steps, residual = lambda_max(df, 1e-6)
    assert abs(value - top) < 1e-9 and (steps, residual) == (0, 0.0)
    row = graph_entropy(df, 1e-6).first()
    assert row.n == len(w) and row.rounds == 0 and row.converged


@pytest.mark.parametrize("edges", [[(1, 2, 1.0), (2, 3, 1.0), (1, 3, 2.0), (3, 4, 1.0)], [(1, 3, 1.0), (1, 4, 2.0), (2, 3, 0.5), (2, 4, 1.0), (3, 4, 1.0)]])
def test_other_graphs_take_steps(spark, edges):
    from skein.operators.entropy import lambda_max

    w = np.zeros((4, 4))
    for a, b, x in edges:
        w[a - 1, b - 1] = w[b - 1, a - 1] = x
    top = np.linalg.eigvalsh(np.eye(4) - w / np.sqrt(np.outer(w.sum(0), w.sum(0))))[-1] / 4
    value, steps, _ = lambda_max(spark.createDataFrame(edges, "src long, dst long, weight double"), 1e-6)
    assert abs(value - top) < 1e-6 and steps > 0
