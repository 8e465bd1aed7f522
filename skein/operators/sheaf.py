"""Sheaf algebra as sparse joins: matrices are rows (row, col, value)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.spectral import entries, largest_eigenvalue, nearest_in_kernel
from skein.operators.storage import written


def coboundary(restrictions: DataFrame) -> DataFrame:
    """SH-1. (row, col, value) from restriction entries (edge, side, vertex, r, c, value): minus the
    map at the source, plus the one at the target. Rows are (edge, r), columns (vertex, c): the
    blocks' places are their own keys, so no running offset is needed."""
    sign = F.when(F.col("side") == "source", -1.0).otherwise(1.0)
    keyed = restrictions.select(F.struct("edge", "r").alias("row"), F.struct("vertex", "c").alias("col"), (sign * F.col("value")).alias("value"))
    # Dealt by row alone, so that what is grouped or joined by row next is in place; a row holds the entries of two stalks.
    keyed = keyed.repartition("row")
    return keyed.groupBy("row", "col").agg(F.sum("value").alias("value")).where("value <> 0")


def distinct_rows(b: DataFrame) -> DataFrame:
    """Entries (row, col, value) of the rows of B at length 1, of equal ones one. The kernel is that of
    B, and so is the nearest point in it; but how well conditioned the Laplacian is no longer
    depends on how often an edge is repeated. Nothing is dropped that the kernel depends on."""
    rows = b.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "value"))).alias("all"))
    size = F.sqrt(F.aggregate("all", F.lit(0.0), lambda s, e: s + e["value"] * e["value"]))
    once = rows.select(F.transform("all", lambda e: F.struct(e["col"].alias("col"), (e["value"] / size).alias("value"))).alias("row")).distinct()
    return once.select("row", F.explode("row").alias("e")).select("row", "e.*")


def sheaf_laplacian(b: DataFrame) -> DataFrame:
    """SH-2. (c1, c2, value) of the transpose of B times B."""
    left, right = b.select("row", F.col("col").alias("c1"), F.col("value").alias("v1")), b.select("row", F.col("col").alias("c2"), F.col("value").alias("v2"))
    return left.join(right, "row").groupBy("c1", "c2").agg(F.sum(F.col("v1") * F.col("v2")).alias("value"))


def dirichlet_energy(b: DataFrame, x: DataFrame) -> DataFrame:
    """SH-3. One row: the squared length of B x."""
    image = b.join(x, "col").groupBy("row").agg(F.sum(F.col("value") * F.col("x")).alias("y"))
    return image.agg(F.coalesce(F.sum(F.col("y") * F.col("y")), F.lit(0.0)).alias("energy"))


def diffuse(laplacian: DataFrame, x: DataFrame, alpha: float, rounds: int, tolerance: float = 1e-8) -> DataFrame:
    """SH-4. x - alpha L x, repeated until |L x| is below ``tolerance`` or for ``rounds`` rounds."""
    for _ in range(rounds):
        lx = laplacian.join(x.select(F.col("col").alias("c2"), "x"), "c2").groupBy(F.col("c1").alias("col")).agg(F.sum(F.col("value") * F.col("x")).alias("lx"))
        x = written(x.join(lx, "col", "left").select("col", (F.col("x") - alpha * F.coalesce("lx", F.lit(0.0))).alias("x"), F.coalesce("lx", F.lit(0.0)).alias("lx")), "state")
        size = math.sqrt(x.agg(F.sum(F.col("lx") * F.col("lx"))).first()[0] or 0.0)
        x = x.select("col", "x")
        if size < tolerance:
            break
    return x


def step_size(laplacian: DataFrame, x: DataFrame, tolerance: float = 1e-4) -> float:
    """0.5 over the largest eigenvalue, by Lanczos from x; 0.5 if that is 0."""
    times = entries(laplacian, "c1", "c2", "value", "col")
    try:
        value, _, _ = largest_eigenvalue(times, x, "col", tolerance)
    finally:
        times.entries.unpersist()
    return 0.5 / value if value > 1e-14 else 0.5


def consensus(laplacian: DataFrame, x: DataFrame, tolerance: float = 1e-8) -> tuple[DataFrame, int, float]:
    """SH-4. ((col, x), steps, |L x|): where ``diffuse`` from x ends, the global section nearest to
    x, by conjugate gradients until |L x| is below ``tolerance``."""
    times = entries(laplacian, "c1", "c2", "value", "col")
    try:
        return nearest_in_kernel(times, x, "col", tolerance)
    finally:
        times.entries.unpersist()


def validate_sheaf(vertices: DataFrame, restrictions: DataFrame) -> DataFrame:
    """SH-5. (edge, side, vertex, issue): unknown ends, entries outside a stalk, values that are no
    finite numbers."""
    both = restrictions.join(vertices, "vertex", "left")
    issue = (
        F.when(F.col("dim").isNull(), "unknown-vertex")
        .when((F.col("c") < 0) | (F.col("c") >= F.col("dim")), "shape-mismatch")
        .when(F.isnan("value") | F.col("value").isNull() | (F.abs("value") == float("inf")), "not-finite")
    )
    return both.withColumn("issue", issue).where("issue is not null").select("edge", "side", "vertex", "issue").distinct()
