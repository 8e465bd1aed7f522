"""Eigenvalues and linear systems of large sparse symmetric matrices, given by what they do to a vector.

A vector is a table (key, ``x``). Each step is one pass over the matrix's entries, a join and a
sum, and leaves one row of sums for the driver; the vectors never leave Spark. Each step's vector
is written out, so that a lost executor costs one step.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.storage import Scratch

#: From a table (key, x) to the table (key, y) of the matrix times x, with the same keys.
Apply = Callable[[DataFrame], DataFrame]


#: The share of a residual below which rounding of doubles hides what is left.
ROUNDING = 1e-13


def entries(matrix: DataFrame, row: str, col: str, value: str, key: str) -> Apply:
    """The action of the entries (row, col, value); keys without an entry get 0. The entries are
    dealt by column once and kept so, and only vectors are shuffled at each step."""
    kept = matrix.select(F.col(row).alias("_row"), F.col(col).alias("_col"), F.col(value).alias("_value")).repartition("_col").persist()

    def apply(x: DataFrame) -> DataFrame:
        named = x.select(F.col(key).alias("_key"), F.col("x").alias("_x"))
        image = kept.join(named, F.col("_col") == F.col("_key")).groupBy("_row").agg(F.sum(F.col("_value") * F.col("_x")).alias("_y"))
        return x.join(image, F.col(key) == F.col("_row"), "left").select(key, F.coalesce("_y", F.lit(0.0)).alias("y"))

    apply.entries = kept
    return apply


def largest_eigenvalue(apply: Apply, start: DataFrame, key: str, tolerance: float = 1e-4, most: int = 500) -> tuple[float, int, float]:
    """(eigenvalue, steps, residual over eigenvalue) of a positive semidefinite matrix, by Lanczos.

    The three-term recurrence needs the last two vectors only; the small tridiagonal matrix of its
    coefficients, one number a step on and beside the diagonal, is solved in the driver. Its
    largest eigenvalue grows to that of the matrix, and the last entry of its eigenvector times
    the next coefficient is the residual, so the caller sees the bound that ended the search.
    Raises if ``most`` steps do not reach ``tolerance``. 0 for a zero matrix or no keys.
    """
    scratch = Scratch(start.sparkSession)
    size = start.agg(F.sum(F.col("x") * F.col("x"))).first()[0]
    if not size:
        return 0.0, 0, 0.0
    state = start.select(key, (F.col("x") / math.sqrt(size)).alias("x"), F.lit(0.0).alias("u"))
    on, beside = [], [0.0]
    for step in range(1, most + 1):
        image = state.join(apply(state.select(key, "x")), key)
        kept = scratch.keep(image.select(key, "x", (F.col("y") - beside[-1] * F.col("u")).alias("w")), "lanczos")
        a = kept.agg(F.sum(F.col("w") * F.col("x"))).first()[0]
        left = F.col("w") - a * F.col("x")
        b = math.sqrt(kept.agg(F.sum(left * left)).first()[0])
        on.append(a)
        values, vectors = np.linalg.eigh(np.diag(on) + np.diag(beside[1:], 1) + np.diag(beside[1:], -1))
        value, residual = float(values[-1]), b * abs(vectors[-1, -1])
        if value <= 1e-14 and b <= 1e-14:
            return 0.0, step, 0.0
        if residual < tolerance * value:
            return value, step, residual / value
        beside.append(b)
        state = kept.select(key, (left / b).alias("x"), F.col("x").alias("u"))
    raise RuntimeError(f"the largest eigenvalue did not settle in {most} steps: residual {residual / value}")


def nearest_in_kernel(apply: Apply, start: DataFrame, key: str, tolerance: float = 1e-8, most: int = 2000) -> tuple[DataFrame, int, float]:
    """(table (key, x), steps, size of the matrix times x): the vector of the kernel of a positive
    semidefinite matrix that is nearest to ``start``, by conjugate gradients.

    That is where steps of x less a small multiple of the matrix times x lead, whatever the
    multiple; conjugate gradients take about the square root of their number. The residual is the
    matrix times x itself, and is taken anew from x before the end, so that rounding cannot hide in
    it. Where ``ROUNDING`` of the first residual is more than ``tolerance``, that ends the search:
    no vector of such numbers is nearer. Raises if ``most`` steps do not reach the end.
    """
    scratch = Scratch(start.sparkSession)
    first, steps, x = True, 0, scratch.keep(start.select(key, F.col("x").cast("double").alias("x")), "begin")
    while True:
        # x, residual r = -A x, direction p
        state = scratch.keep(x.join(apply(x), key).select(key, "x", (-F.col("y")).alias("r"), (-F.col("y")).alias("p")), "residual")
        rr = state.agg(F.coalesce(F.sum(F.col("r") * F.col("r")), F.lit(0.0))).first()[0]
        if first:
            first, tolerance = False, max(tolerance, ROUNDING * math.sqrt(rr))
        if math.sqrt(rr) < tolerance:
            return state.select(key, "x"), steps, math.sqrt(rr)
        while math.sqrt(rr) >= tolerance / 2:
            if steps >= most:
                raise RuntimeError(f"no kernel vector in {most} steps: {math.sqrt(rr)} left")
            steps += 1
            moved = scratch.keep(state.join(apply(state.select(key, F.col("p").alias("x"))), key), "moved")
            pq = moved.agg(F.sum(F.col("p") * F.col("y"))).first()[0]
            if pq <= 0:  # the direction is in the kernel up to rounding
                break
            a = rr / pq
            left = F.col("r") - a * F.col("y")
            now = moved.agg(F.sum(left * left)).first()[0]
            state = moved.select(key, (F.col("x") + a * F.col("p")).alias("x"), left.alias("r"), (left + now / rr * F.col("p")).alias("p"))
            rr = now
        x = scratch.keep(state.select(key, "x"), "restart")
