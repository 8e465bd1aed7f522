"""Whiten embeddings by a covariance from variances alone (polarisation).

With exact sums of squares of every dimension and of every sum of two dimensions, the covariance
of two is half of what the variance of their sum has more than their own. Entries are fixed-point
whole numbers, centred at the mean rounded down before they are squared, and the sums are exact
integers, so that nothing is lost to rounding before the covariance is divided by the squared
count. The matrix, of a fixed size, is decomposed in the driver; everything by row runs in tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.runtime import written

#: Where fixed-point entries begin, and steps in a unit.
OFFSET, STEPS = 1_000_000, 64
#: Vectors in one exact sum of 64-bit squares.
ROWS = 1 << 12


def fixed_point(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, ``x`` array of longs): each entry c as floor(64 * c) + 1000000. Rows whose vector is
    null or has a null, infinite or NaN entry are left out. An entry beyond a long is an error."""
    v = F.col(f"`{vector_col}`")
    whole = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")) & ~F.isnan(c.cast("double")))
    return embeddings.where(whole).select(F.col(f"`{id_col}`").alias("id"), F.transform(v, lambda c: F.floor(c.cast("double") * STEPS).cast("long") + OFFSET).alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def squares(y: np.ndarray) -> list[int]:
    """The exact sums of squares of each dimension, then of each sum of two dimensions i < j."""
    if not len(y):
        return [0] * (y.shape[1] * (y.shape[1] + 1) // 2)
    out = [0] * (y.shape[1] * (y.shape[1] + 1) // 2)
    small = 2 * max(abs(int(y.max())), abs(int(y.min()))) < 1 << 25  # 2^50 a square, 2^12 of them
    for k in range(0, len(y), ROWS):
        part = y[k : k + ROWS] if small else y[k : k + ROWS].astype(object)
        sums = [part * part, *((part[:, i : i + 1] + part[:, i + 1 :]) ** 2 for i in range(part.shape[1] - 1))]
        out = [a + int(b) for a, b in zip(out, np.concatenate([s.sum(axis=0) for s in sums]))]
    return out


@dataclass(frozen=True)
class Whitening:
    """What is known of the fit list: its size, exact sums, centre, and the components by falling
    eigenvalue with their explained shares."""

    n: int
    sums: list[int]
    centre: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def whiten(self, x: np.ndarray) -> np.ndarray:
        rest = np.array([(s - self.n * c) / self.n for s, c in zip(self.sums, self.centre)])
        return ((x - np.array(self.centre, np.int64)) - rest) @ self.components / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """The exact sum of (n * x - S) ** 2 over the dimensions, an error beyond a long."""
        y, rest = x - np.array(self.centre, np.int64), [s - self.n * c for s, c in zip(self.sums, self.centre)]
        if self.n * (int(np.abs(y).max(initial=0)) + 1) < 1 << 28 and x.shape[1] < 64:
            d = self.n * y - np.array(rest, np.int64)
            return (d * d).sum(axis=1)
        d = self.n * y.astype(object) - np.array(rest, object)
        return np.array((d * d).sum(axis=1).tolist(), np.int64)


def fit(vectors: DataFrame, components: int = 16) -> Whitening | None:
    """The whitening of the distinct ``x`` of ``vectors``; None without any. Vectors of different
    lengths are an error. Components without variance (beyond rounding) are left out."""
    shape = vectors.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high"), F.count(F.lit(1)).alias("n")).first()
    if not shape["n"] or not shape["high"]:
        return None
    if shape["low"] != shape["high"]:
        raise ValueError(f"vectors of {shape['low']} to {shape['high']} entries")
    dims, n = shape["high"], shape["n"]
    sums = [int(s) for s in vectors.agg(*[F.sum(F.get("x", F.lit(i)).cast("decimal(38,0)")) for i in range(dims)]).first()]
    centre = [s // n for s in sums]
    names = [(i, i) for i in range(dims)] + [(i, j) for i in range(dims) for j in range(i + 1, dims)]

    def run(batches):
        total = [0] * len(names)
        for batch in batches:
            total = [a + b for a, b in zip(total, squares(_matrix(batch.column(0), dims) - np.array(centre, np.int64)))]
        high, low = [t >> 40 for t in total], [t & (1 << 40) - 1 for t in total]
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(names)), pa.int32()), "high": pa.array(high, pa.int64()), "low": pa.array(low, pa.int64())})

    summed = vectors.select("x").mapInArrow(run, "at int, high long, low long")
    exact = F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")
    square = {r["at"]: (int(r["high"]) << 40) + int(r["low"]) for r in summed.groupBy("at").agg(*exact).collect()}  # a number a pair of dimensions
    rest = [s - n * c for s, c in zip(sums, centre)]
    # n^2 times a variance is a whole number: n * sum of squares - square of the sum.
    own = [n * square[i] - rest[i] ** 2 for i in range(dims)]
    v = np.empty((dims, dims))
    for at, (i, j) in enumerate(names):
        both = own[i] if i == j else (n * square[at] - (rest[i] + rest[j]) ** 2 - own[i] - own[j]) // 2
        v[i, j] = v[j, i] = both / (n * n)  # whole numbers, divided once
    values, vectors_ = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values.max(), 0) * dims * np.finfo(float).eps]
    trace = sum(own) / (n * n)
    return Whitening(n, sums, centre, vectors_[:, order], values[order], values[order] / trace)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened ``x`` less the identity."""
    k = len(model.values)

    def total(of) -> np.ndarray:
        def run(batches):
            out = 0
            for batch in batches:
                out = out + of(model.whiten(_matrix(batch.column(0), len(model.centre))))
            flat = np.atleast_1d(out).ravel()
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(flat)), pa.int32()), "v": pa.array(flat, pa.float64())})

        found = vectors.select("x").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()  # k * k rows
        return found.sort_values("at")["v"].to_numpy()[-k * k :] / model.n

    if not k:
        return 0.0
    mean = total(lambda w: w.sum(axis=0))[-k:]
    covariance = total(lambda w: (w - mean).T @ (w - mean)).reshape(k, k)
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(embeddings: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, ``component`` int from 1, ``n`` long, ``deviation`` long, ``whitened``, ``explained``
    and ``identity_error`` doubles) for each row with a whole vector and each component.

    The fit list is every distinct vector of fixed-point entries once, so that copies do not pull.
    Rows that repeat an id, null ids included, are whitened by themselves. Null vectors and those
    with null or non-finite entries are left out; a component without variance has no rows, so
    that a table of one distinct vector, like an empty one, gives an empty table. Vectors of
    different lengths, and numbers beyond a long, are errors. Other columns are left out.
    """
    rows = fixed_point(embeddings, id_col, vector_col)
    spark, kind = embeddings.sparkSession, rows.schema["id"].dataType
    number = lambda name, type_: T.StructField(name, type_)
    out = T.StructType([number(id_col, kind), number("component", T.IntegerType()), number("n", T.LongType()), number("deviation", T.LongType()),
                        number("whitened", T.DoubleType()), number("explained", T.DoubleType()), number("identity_error", T.DoubleType())])
    distinct = written(rows.select("x").distinct(), "fit-list")
    model = fit(distinct, components)
    if model is None or not len(model.values):
        return spark.createDataFrame([], out)
    error, k = identity_error(distinct, model), len(model.values)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), len(model.centre))
            m = len(x)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                pa.array(np.repeat(model.deviation(x), k)), pa.array(model.whiten(x).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return rows.mapInArrow(run, out)
