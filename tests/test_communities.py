"""Leiden communities and sampled betweenness on random and planted graphs."""

import itertools
import random
from collections import defaultdict

import pytest
from test_graph import brute_betweenness, edges_df, random_edges

from skein.operators import graph, leiden


def modularity(edges, part):
    m2, inside, total = 2 * sum(w for *_, w in edges), 0, defaultdict(float)
    for a, b, w in edges:
        total[part[a]] += w
        total[part[b]] += w
        inside += 2 * w * (part[a] == part[b])
    return inside / m2 - sum(t * t for t in total.values()) / m2**2


def connected(edges, nodes):
    near = defaultdict(set)
    for a, b, _ in edges:
        near[a].add(b)
        near[b].add(a)
    seen, stack = {min(nodes)}, [min(nodes)]
    while stack:
        for v in near[stack.pop()] & nodes - seen:
            seen.add(v)
            stack.append(v)
    return seen == nodes


def test_no_node_gains_by_a_move(spark):
    edges = random_edges(14, 26, 1)
    part = dict(leiden.communities(edges_df(spark, edges)).collect())
    assert set(part) == {v for a, b, _ in edges for v in (a, b)}
    members = defaultdict(set)
    for v, c in part.items():
        members[c].add(v)
    q = modularity(edges, part)
    for v in part:
        for c in members:
            assert modularity(edges, part | {v: c}) <= q + 1e-9
    for c, nodes in members.items():
        assert c == min(nodes) and connected(edges, nodes)


def test_planted_groups_are_found(spark):
    r = random.Random(3)
    groups = [range(8 * g, 8 * g + 8) for g in range(2)]
    edges = [(a, b, 1) for g in groups for a, b in itertools.combinations(g, 2) if r.random() < 0.8]
    edges += [(r.choice(groups[g]), r.choice(groups[h]), 1) for g, h in itertools.combinations(range(2), 2)]
    found = dict(leiden.communities(edges_df(spark, edges)).collect())
    assert found == {v: 8 * (v // 8) for v in range(16)}


def test_communities_of_little(spark):
    assert leiden.communities(edges_df(spark, [(0, 1, 1)]).where("false")).count() == 0
    assert dict(leiden.communities(edges_df(spark, [(0, 1, 1), (2, 3, 1), (4, 4, 2)])).collect()) == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def test_sampled_betweenness_to_the_end_is_exact(spark):
    edges = random_edges(14, 24, 8)
    nodes = {v for a, b, _ in edges for v in (a, b)}
    found, asked = graph.sampled_betweenness(edges_df(spark, edges), len(nodes), error=0.0, first=3)
    got = {r.node: (r.betweenness, r.error) for r in found.collect()}
    want = brute_betweenness(edges, len(nodes))
    assert asked == len(nodes) and {v: b for v, (b, _) in got.items()} == pytest.approx(want) and all(e == pytest.approx(0, abs=1e-9) for _, e in got.values())


def test_sampled_betweenness_stops_within_its_error(spark):
    """Spokes about three hubs: the hubs' shares vary little from source to source."""
    edges = [(h, v, 1) for h in range(3) for v in range(10 + 60 * h, 70 + 60 * h)] + [(0, 1, 1), (1, 2, 1)]
    n = 183
    found, asked = graph.sampled_betweenness(edges_df(spark, edges), n, error=0.3, top=3, first=20)
    got = {r.node: r for r in found.collect()}
    want = brute_betweenness(edges, n)
    assert asked < n and len(got) == n
    for h in range(3):
        assert got[h].error <= 0.3 * got[h].betweenness and abs(got[h].betweenness - want[h]) <= 2 * got[h].error


def test_pairs_meet_without_walks_over_all_edges(spark, monkeypatch):
    """In lists and groups of a few entries, with a second component, a loop and nodes without edges,
    which took the figures up by their share."""
    monkeypatch.setattr(graph, "breadth_first", None)
    for name, value in (("PIECE", 2), ("GROUP", 8), ("ROW", 1)):
        monkeypatch.setattr(graph, name, value)
    edges = random_edges(11, 14, 6) + [(20, 21, 1), (21, 22, 1)]
    found, asked = graph.sampled_betweenness(edges_df(spark, [*edges, (20, 20, 1)]), 18, error=0.0, first=200)
    got = {r.node: (r.betweenness, r.error) for r in found.collect()}
    want = brute_betweenness(edges, 18)
    assert asked == len(want) and {v: b for v, (b, _) in got.items()} == pytest.approx(want) and all(e == pytest.approx(0, abs=1e-9) for _, e in got.values())


def settled(edges, part):
    members = defaultdict(set)
    for v, c in part.items():
        members[c].add(v)
    q = modularity(edges, part)
    return all(modularity(edges, part | {v: c}) <= q + 1e-9 for v in part for c in members) and all(c == min(vs) and connected(edges, vs) for c, vs in members.items())


def test_no_node_gains_by_a_move_across_blocks(spark, monkeypatch):
    """Nodes and large communities dealt over several blocks."""
    monkeypatch.setattr(leiden, "BLOCK", 40)
    edges = random_edges(18, 36, 4)
    part = dict(leiden.communities(edges_df(spark, edges)).collect())
    assert set(part) == {v for a, b, _ in edges for v in (a, b)} and settled(edges, part)


def test_a_graph_of_one_block_takes_few_jobs(spark):
    """Rounds of single moves took hundreds of jobs on a graph of this size."""
    edges = random_edges(60, 150, 5)
    spark.sparkContext.setJobGroup("communities", "few")
    try:
        part = dict(leiden.communities(edges_df(spark, edges)).collect())
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("communities"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert settled(edges, part) and jobs < 80


def test_numbered_tokens_have_communities(spark, monkeypatch):
    """By the query's way: lists, numbers, communities of numbers, in one block and in several."""
    r = random.Random(9)
    lists = spark.createDataFrame([([r.choice("abcdefghi"[3 * (d % 3) :][:5]) for _ in range(5)],) for d in range(12)], "tokens array<string>")
    want = {x for row in lists.collect() for x in row.tokens}
    names, edges, _ = graph.numbered(lists)
    name = {x.id: x.node for x in names.collect()}
    plain = [(x.src, x.dst, x.weight) for x in edges.collect()]
    for block in (1 << 21, 30):
        monkeypatch.setattr(leiden, "BLOCK", block)
        part = dict(leiden.communities_of_numbers(edges).collect())
        assert {name[v] for v in part} == want and settled(plain, part)
