"""Graph operators on token lists against those on token tables, and plans without windows over tokens."""

import random

import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import graph, storage
from skein.plans import graphs

KEYS = ["doc_id", "seg"]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both(spark):
    r = random.Random(5)
    rows = [(d, s, [r.choice("abcde") for _ in range(r.randint(0, 7))]) for d in range(12) for s in range(4)]
    lists = spark.createDataFrame(rows, "doc_id long, seg int, tokens array<string>").cache()
    return lists, lists.select(*KEYS, F.posexplode("tokens").alias("pos", "token")).cache()


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_lists_give_what_tables_give(both):
    lists, tokens = both
    assert rows(graph.edges_of_lists(lists), "src", "dst", "weight") == rows(graph.cooccurrence_edges(tokens, KEYS), "src", "dst", "weight")
    assert rows(graph.phrase_edges_of_lists(lists, KEYS), "phrase", "w", "weight") == rows(graph.phrase_edges(tokens, KEYS), "phrase", "w", "weight")
    counted = graph.promoted_phrases(tokens, KEYS).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    assert rows(graph.promoted_counts(lists, KEYS), "a", "b", "n") == rows(counted, "a", "b", "n")
    assert rows(graph.artifacts_of_lists(lists, *KEYS), "src", "dst", "weight") == rows(graph.segmentation_artifacts(tokens, *KEYS), "src", "dst", "weight")
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id", "seg").alias("segs"))
    assert rows(graph.token_counts(lists), "token", "n", "segs") == rows(counts, "token", "n", "segs")


def test_artifacts_as_without_marks(spark):
    parts = ["word", "a.b", "x->y", "it's \"k\": 3", '"name"', "http://a/b c", "./a/b/c.py", "snake_case_x", "`code`", "```\nx\n```", "0a1b2c3d-0000-1111-2222-0123456789ab", "well-known", ": 4.5", "é.ab", "end"]
    r = random.Random(2)
    data = [(None,), ("",), *[(" ".join(r.choice(parts) for _ in range(r.randint(1, 9))),) for _ in range(400)]]
    df = spark.createDataFrame(data, "t string")
    plain = F.col("t")
    for pattern in T.ARTIFACTS:
        plain = F.regexp_replace(plain, pattern, " ")
    assert df.where(~T.strip_artifacts(F.col("t")).eqNullSafe(T.collapse(plain))).count() == 0


@pytest.mark.parametrize("query", [graphs.phrase_edges, graphs.promoted_phrases, graphs.cooccurrence, graphs.segmentation_artifacts])
def test_no_window_over_tokens(spark, query):
    plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_queries_of_nodes_make_no_edges(spark, monkeypatch):
    monkeypatch.setattr(graph, "edges_of_lists", None)
    assert graphs.top_nodes(spark, SF).count() == 10


@pytest.mark.parametrize("shared", [False, True])
def test_links_between_parts_are_those_of_named_edges(spark, monkeypatch, shared):
    rng = random.Random(11)
    data = [(i, 0, [rng.choice(["a", "bb", "ccc", "dddd", "ee", "fff", "élan"]) for _ in range(rng.randrange(9))]) for i in range(40)]
    lists = spark.createDataFrame(data, "doc_id long, seg int, tokens array<string>")
    part = lambda t: F.pmod(F.char_length(t), F.lit(3))
    want = graph.edges_of_lists(lists).groupBy(part("src").alias("ca"), part("dst").alias("cb")).agg(F.count(F.lit(1)).alias("links"), F.sum("weight").alias("weight"))
    one = want.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("links"), F.sum("weight"))
    nodes = graph.token_counts(lists).select(F.col("token").alias("node"))
    if shared:  # every token has the same hash
        monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(5).cast("long"))
    got = graph.links_of_lists(lists, nodes, part, 3).groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("links"), F.sum("weight"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, one.collect()))


def test_queries_of_communities_make_no_table_of_named_edges(spark, monkeypatch):
    def no(*_):
        raise AssertionError("a table of edges")

    monkeypatch.setattr(graphs, "_labelled", no)
    assert graphs.gap_modularity_delta(spark, "/root/testdata/sf0.001").columns == ["ca", "cb", "delta"]


def test_promoted_counts_under_numbers(both):
    lists, tokens = both
    assert rows(graph.promoted_counts(lists, KEYS, (3, 3)), "a", "b", "n") == rows(graph.promoted_counts(lists, KEYS), "a", "b", "n")


def test_places_that_fit_no_number(spark):
    bits = lambda data: graph.place_bits(spark.createDataFrame(data, "doc_id long, text string"), "doc_id", "text")
    assert bits([(5, "a b"), (1 << 40, None)]) == (2, 2) and bits([(0, None)]) == (0, 0)
    assert bits([(1 << 62, "a b")]) is None and bits([(-1, "a")]) is None and bits([(None, "a"), (1, "a")]) is None and bits([]) is None


def test_promoted_phrases_are_not_sorted(spark):
    plan = graphs.promoted_phrases(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate(key=[a#" not in plan  # TX-3 alone sorts


def test_white_space_as_by_patterns(spark):
    r = random.Random(4)
    data = [(None,), ("",), *[("".join(r.choice(" \t\n\x0b\f\r\u00a0\u2003ab") for _ in range(r.randint(0, 8))),) for _ in range(500)]]
    df, t = spark.createDataFrame(data, "t string"), F.col("t")
    plain = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    assert df.where(~T.trim_space(t).eqNullSafe(plain(t)) | ~T.collapse(t).eqNullSafe(plain(F.regexp_replace(t, r"\s+", " ")))).count() == 0


def test_provenance_of_lists(both):
    lists, tokens = both
    names = ["text", "gap", "user"]
    origin = F.element_at(F.array(*map(F.lit, names)), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    born = F.pmod(F.col("doc_id") * 5, F.lit(7)) - 3  # of one iteration there are several origins
    want = graph.edge_provenance(graph.pairs_in_window(tokens, KEYS), born, origin)
    assert rows(graph.provenance_of_lists(lists, born, origin, names), "src", "dst", "iteration", "origin") == rows(want, "src", "dst", "iteration", "origin")


@pytest.mark.parametrize("query", [graphs.edge_provenance, graphs.new_edges])
def test_provenance_sorts_no_pairs(spark, query):
    """The one sort left is that of segments, before their first occurrences."""
    plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert "Window" not in plan and plan.count("SortAggregate") == 2


@pytest.mark.parametrize("rounds", [0, 1, 2, 4])
def test_label_propagation_of_numbers(both, rounds):
    lists, tokens = both
    names, edges, bits = graph.numbered(lists)
    plain = graph.cooccurrence_edges(tokens, KEYS)
    a, b = names.toDF("a", "src"), names.toDF("b", "dst")
    assert rows(edges.toDF("src", "dst", "weight").join(a, "src").join(b, "dst"), "a", "b", "weight") == rows(plain, "src", "dst", "weight")
    assert rows(graph.label_propagation_of_numbers(edges, names, bits, rounds), "node", "community") == rows(graph.label_propagation(plain, rounds), "node", "community")


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    """They stayed until the driver's garbage was collected, so that all steps of a query were on disk at once."""
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in local.getAllFiles().mkString("\n").splitlines() if "shuffle_" in x}
    before = files()
    storage.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    assert not files() - before


@pytest.mark.parametrize("bits", [None, (3, 4)])
def test_phrases_by_numbers(both, bits):
    lists, tokens = both
    found = graph.phrase_edges_of_lists(lists, KEYS, bits=bits)
    assert rows(found, "phrase", "w", "weight") == rows(graph.phrase_edges(tokens, KEYS), "phrase", "w", "weight")
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "Join" not in plan and plan.count("Exchange") == 1  # nothing but the last sum is on disk with it
