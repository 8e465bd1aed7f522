"""Graph and embedding entropy over edges (src, dst, weight) and vectors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.graph import both_ways
from skein.operators.spectral import entries, largest_eigenvalue
from skein.operators.storage import written


def normalize_edges(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """EN-1. Self-loops and edges to unknown nodes gone, repeated edges summed, src < dst."""
    kept = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight"))
    if nodes is None:
        return kept
    return kept.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "weight")


def strength(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("node").agg(F.sum("weight").alias("d"))


def edge_terms(edges: DataFrame) -> DataFrame:
    """(src, dst, weight, di, dj, term): w^2 / (di dj) of each edge."""
    d = strength(edges)
    both = edges.join(d.toDF("src", "di"), "src").join(d.toDF("dst", "dj"), "dst")
    return both.select("src", "dst", "weight", "di", "dj", (F.col("weight") * F.col("weight") / (F.col("di") * F.col("dj"))).alias("term"))


def quadratic_entropy(edges: DataFrame, n_nodes: int | None = None) -> DataFrame:
    """EN-2. One row (n, q): 1 - (n + 2 sum w^2 / (di dj)) / n^2; 0 without edges. ``n_nodes``
    counts nodes without edges as well."""
    total = edge_terms(edges).agg(F.coalesce(F.sum("term"), F.lit(0.0)).alias("s"))
    n = strength(edges).agg(F.count(F.lit(1)).alias("n")) if n_nodes is None else edges.sparkSession.range(1).select(F.lit(n_nodes).cast("long").alias("n"))
    return total.join(n, F.lit(True)).select("n", F.when(F.col("s") == 0, 0.0).otherwise(1 - (F.col("n") + 2 * F.col("s")) / (F.col("n") * F.col("n"))).alias("q"))  # one row each


def entropy_closed_form(edges: DataFrame) -> DataFrame:
    """EN-3. -Q ln(2 / n); 0 for n of 2 or less or Q of 0 or less."""
    h = F.when((F.col("n") <= 2) | (F.col("q") <= 0), 0.0).otherwise(-F.col("q") * F.log(2.0 / F.col("n")))
    return quadratic_entropy(edges).select("n", "q", h.alias("entropy"))


def _scaled(edges: DataFrame) -> DataFrame:
    """(node, other, weight) both ways: w / sqrt(di dj) of each edge."""
    terms = edge_terms(edges).select("src", "dst", (F.col("weight") / F.sqrt(F.col("di") * F.col("dj"))).alias("weight"))
    return written(both_ways(written(terms, "scaled")), "near")


def _start(near: DataFrame) -> DataFrame:
    """A fixed vector that is not uniform."""
    return written(near.select("node").distinct().withColumn("x", 1 + F.pmod(F.col("node") * 2654435761, F.lit(1000)) / 1000), "start")


def _sides(edges: DataFrame) -> tuple[int, bool]:
    """(nodes, whether the edges run between two sides: no node is ``src`` of one and ``dst`` of another)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(False).alias("upper")), F.struct(F.col("dst").alias("node"), F.lit(True).alias("upper")))).alias("e")).select("e.*")
    n, mixed = ends.groupBy("node").agg((F.max("upper") & ~F.min("upper")).alias("mixed")).agg(F.count(F.lit(1)), F.count_if("mixed")).first()
    return n, not mixed


def lambda_max(edges: DataFrame, tolerance: float = 1e-4) -> tuple[float, int, float]:
    """EN-4. (eigenvalue, steps, residual) of the normalized Laplacian over n, by Lanczos until the
    residual is below ``tolerance`` times the eigenvalue. Without edges all three are 0.

    No eigenvalue is above 2, and the roots of the strengths, negative on one side, belong to 2 where
    edges of positive weight run between two sides: such graphs (of things and what they hold) take
    no step. Which side a node is on is read off its edges, so others take the steps as ever.
    """
    n, sides = _sides(edges)
    if not n:
        return 0.0, 0, 0.0
    if sides and not edges.where("src = dst or not coalesce(weight > 0 and weight < double('Infinity'), false)").limit(1).count():
        return 2.0 / n, 0, 0.0
    near = _scaled(edges)
    x = _start(near)
    times = entries(near, "node", "other", "weight", "node")
    less = lambda v: v.join(times(v), "node").select("node", (F.col("x") - F.col("y")).alias("y"))
    try:
        value, steps, residual = largest_eigenvalue(less, x, "node", tolerance)
    finally:
        times.entries.unpersist()
    return value / n, steps, residual


def power_steps(edges: DataFrame, steps: int) -> float:
    """The Rayleigh quotient of the normalized Laplacian over n after so many steps of power
    iteration from a fixed start; 0 without edges."""
    near, value = _scaled(edges), 0.0
    x = _start(near)
    n = x.count()
    for _ in range(steps if n else 0):
        dot = near.join(x.select(F.col("node").alias("other"), F.col("x").alias("xo")), "other").groupBy("node").agg(F.sum(F.col("weight") * F.col("xo")).alias("a"))
        both = written(x.join(dot, "node").select("node", "x", ((F.col("x") - F.col("a")) / n).alias("y")), "vector")
        xx, xy, yy = both.agg(F.sum(F.col("x") * F.col("x")), F.sum(F.col("x") * F.col("y")), F.sum(F.col("y") * F.col("y"))).first()
        value = xy / xx
        if not yy:
            break
        x = both.select("node", (F.col("y") / math.sqrt(yy)).alias("x"))
    return value


def graph_entropy(edges: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """EN-5. -Q ln(lambda), 0 unless 0 < lambda < 1 and Q > 0; with the steps and the residual
    that ended the search for lambda."""
    edges = written(edges, "edges")
    value, steps, residual = lambda_max(edges, tolerance)
    q = quadratic_entropy(edges)
    h = F.when((F.col("q") > 0) & F.lit(0 < value < 1), -F.col("q") * F.lit(math.log(value) if value > 0 else 0.0)).otherwise(0.0)
    return q.select("n", "q", F.lit(value).alias("lambda"), h.alias("entropy"), F.lit(steps).alias("rounds"), F.lit(residual).alias("residual"), F.lit(residual < tolerance).alias("converged"))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c, wab, wac, wbc) of every triangle of simple edges, once. Edges point from the end of
    the lower degree, so that a node has at most sqrt(2 E) of them to pair, however large a hub."""
    n = both_ways(edges).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    both = edges.join(n.toDF("src", "ns"), "src").join(n.toDF("dst", "nd"), "dst")
    up = F.struct("ns", "src") < F.struct("nd", "dst")
    out = written(both.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"), "weight"), "oriented")
    left, right = out.toDF("a", "b", "wab"), out.toDF("a", "c", "wac")
    wedges = left.join(right, "a").where("b < c")
    closing = out.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("c"), F.col("weight").alias("wbc"))
    return wedges.join(closing, ["b", "c"]).select("a", "b", "c", "wab", "wac", "wbc")


def entropy_centrality(edges: DataFrame) -> DataFrame:
    """EN-6. (node, score): Q less Q without the node. Removing v takes its own edges, and lowers the
    degree of each neighbour u, which scales the terms of u's other edges by d / (d - w).

    With S the sum of a node's w^2 / d(other), that is a sum over the edges of v, once every edge
    with both ends at v's neighbours, a triangle, is given what the two factors have together
    beyond their sum.
    """
    terms = written(edge_terms(edges), "terms")
    total, n = terms.agg(F.sum("term")).first()[0] or 0.0, strength(edges).count()
    ends = F.array(F.struct(F.col("src").alias("v"), F.col("dst").alias("u"), F.col("di").alias("dv"), F.col("dj").alias("du")), F.struct(F.col("dst").alias("v"), F.col("src").alias("u"), F.col("dj").alias("dv"), F.col("di").alias("du")))
    near = terms.select("weight", "term", F.explode(ends).alias("e")).select("weight", "term", "e.*")
    own = near.groupBy("v").agg(F.sum("term").alias("own"), F.first("dv").alias("d"))
    around = near.groupBy(F.col("v").alias("u")).agg(F.sum(F.col("weight") * F.col("weight") / F.col("du")).alias("s"))
    left_over = F.col("du") - F.col("weight")
    grown = F.when(left_over <= 1e-12 * F.col("du"), 0.0).otherwise((F.col("s") - F.col("weight") * F.col("weight") / F.col("dv")) * (1 / left_over - 1 / F.col("du")))
    change = near.join(around, "u").groupBy("v").agg(F.sum(grown).alias("change"))
    d = own.select(F.col("v").alias("node"), "d")
    found = triangles(terms.select("src", "dst", "weight"))
    for c in "abc":
        found = found.join(d.toDF(c, f"d{c}"), c)
    extra = lambda x, wx, y, wy, w: F.col(w) * F.col(w) / (F.col(x) * F.col(y)) * (F.col(x) / (F.col(x) - F.col(wx)) - 1) * (F.col(y) / (F.col(y) - F.col(wy)) - 1)
    of = F.array(
        F.struct(F.col("a").alias("v"), extra("db", "wab", "dc", "wac", "wbc").alias("x")), F.struct(F.col("b").alias("v"), extra("da", "wab", "dc", "wbc", "wac").alias("x")),
        F.struct(F.col("c").alias("v"), extra("da", "wac", "db", "wbc", "wab").alias("x")),
    )
    together = found.select(F.explode(of).alias("t")).select("t.*").groupBy("v").agg(F.sum("x").alias("together"))
    left = F.lit(total) - F.col("own") + F.coalesce("change", F.lit(0.0)) + F.coalesce("together", F.lit(0.0))
    q = 1 - (n + 2 * total) / (n * n)
    without = 1 - (F.lit(n - 1) + 2 * left) / float((n - 1) * (n - 1))
    return own.join(change, "v", "left").join(together, "v", "left").select(F.col("v").alias("node"), (F.lit(q) - without).alias("score"))


def second_moment(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """EN-7. (group, i, j, m) for i <= j: mean of x_i x_j. Vectors are cut up inside a row."""
    at = vectors.select(group, F.posexplode(vector).alias("i", "xi"), vector)
    tail = at.select(group, "i", "xi", F.posexplode(F.slice(vector, F.col("i") + 1, F.size(vector))).alias("k", "xj"))
    return tail.groupBy(group, "i", (F.col("i") + F.col("k")).alias("j")).agg(F.avg(F.col("xi").cast("double") * F.col("xj")).alias("m"))


def embedding_entropy(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """EN-8. Shannon entropy of the normalized eigenvalues of a group's second moment, whose size is
    fixed by the dimension; 0 for one vector or none with mass."""
    moments = second_moment(vectors, group, vector)
    kind = dict(vectors.dtypes)[group]

    def eigen(pdf):
        import pandas as pd

        d = int(pdf["j"].max()) + 1
        m = np.zeros((d, d))
        m[pdf["i"], pdf["j"]] = pdf["m"]
        m[pdf["j"], pdf["i"]] = pdf["m"]
        values = np.clip(np.linalg.eigvalsh(m), 0, None)
        p = values / values.sum() if values.sum() > 0 else values
        p = p[p > 1e-15]
        return pd.DataFrame({group: [pdf[group].iloc[0]], "entropy": [float(-(p * np.log(p)).sum())]})

    found = moments.groupBy(group).applyInPandas(eigen, f"{group} {kind}, entropy double")
    count = vectors.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return count.join(found, group).select(group, "n", F.when(F.col("n") <= 1, 0.0).otherwise(F.col("entropy")).alias("entropy"))


def purity_entropy(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """EN-9. 1 - |M|^2 / (tr M)^2, without eigenvalues; 0 without mass."""
    m = F.col("m")
    sums = second_moment(vectors, group, vector).groupBy(group).agg(F.sum(F.when(F.col("i") == F.col("j"), m * m).otherwise(2 * m * m)).alias("f"), F.sum(F.when(F.col("i") == F.col("j"), m)).alias("t"))
    return sums.select(group, F.when(F.col("t") == 0, 0.0).otherwise(1 - F.col("f") / (F.col("t") * F.col("t"))).alias("purity_entropy"))
