"""Graphs deeper than fifty hops."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skein.operators import graph

N = 55


def test_reachable_from_the_end_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(N)], "src long, dst long")
    got = graph.reachable_from(edges, spark.createDataFrame([(0,)], "start long"))
    assert sorted(r.node for r in got.collect()) == list(range(1, N + 1))


def test_breadth_first_on_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(N)], "src long, dst long, weight double")
    got = graph.breadth_first(edges, spark.createDataFrame([(0,), (2,)], "source long")).collect()
    assert sorted((r.source, r.node, r.hops, r.paths) for r in got) == [(s, i, abs(i - s), 1.0) for s in (0, 2) for i in range(N + 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_reachable_from_on_chains_forks_and_cycles(spark, seed):
    r = random.Random(seed)
    edges = {(i, i + 1) for i in range(0, 90) if i % 30 != 29} | {(89, 60), (5, 40), (5, 5), (20, 100), (100, 101), (101, 100)} | {(r.randrange(110), r.randrange(110)) for _ in range(12)}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
    want = set()
    for s in (0, 7, 61, 100, 109):
        stack, seen = list(near[s]), set(near[s])
        while stack:
            for v in near[stack.pop()] - seen:
                seen.add(v)
                stack.append(v)
        want |= {(s, v) for v in seen}
    df = spark.createDataFrame(sorted(edges) + [(3, None), (None, 3)], "src long, dst long")
    got = graph.reachable_from(df, spark.createDataFrame([(s,) for s in (0, 7, 61, 100, 109)], "start long")).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_a_long_chain_takes_few_tables(spark, monkeypatch):
    made = []
    real = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: made.append(name) or real(df, name))
    n = 2000
    edges = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.reachable_from(edges, spark.createDataFrame([(0,)], "start long")).count() == n
    assert len(made) < 40
