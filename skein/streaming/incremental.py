"""Streams of segments, entries, findings and metric rows.

Order within a stream is by a column (document, iteration), not by arrival. First-wins dedup in a
stream keeps the first to arrive; feed files in order to match the batch form.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.functions.text import segment_key
from skein.operators.graph import cooccurrence_edges


def confirm(state: dict, iteration: int, correlation: float, h: int) -> bool:
    """One step of TS-8; ``state`` holds the last sign, the candidate's start and recent signs."""
    sign = (correlation > 0) - (correlation < 0)
    state["recent"] = [*state.get("recent", []), sign][-3:]
    if sign and state.get("sign") and sign != state["sign"]:
        state["start"], state["want"] = iteration, sign
    if sign:
        state["sign"] = sign
    start = state.get("start")
    if start is None or iteration - start < 3 or h < 2:
        return False
    if sum(s == state["want"] for s in state["recent"]) < 0.6 * len(state["recent"]):
        return False
    state["start"] = None
    return True


def dedup_segments(segments: DataFrame) -> DataFrame:
    """TX-3 as a stream: the first of each segment, by key, across micro-batches."""
    return segments.withColumn("_key", segment_key(F.col("segment"))).dropDuplicates(["_key"]).drop("_key")


def dedup_findings(rows: DataFrame, fields: list[str]) -> DataFrame:
    """FI-2 as a stream: the first finding of each fingerprint."""
    mark = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in fields]), 256)
    return rows.withColumn("fingerprint", mark).dropDuplicates(["fingerprint"])


class EdgeTable:
    """GR-1 as a stream: a table of edge sums to which each micro-batch adds (use as foreachBatch).

    The sums of a batch are appended under its number, so that a batch that is run again replaces
    its own part; reading sums over the parts, and ``compact`` folds them into one.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path, keys

    def add(self, tokens: DataFrame, batch: int) -> None:
        cooccurrence_edges(tokens, self.keys).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))

    def compact(self, path: str | None = None) -> EdgeTable:
        """The same sums as one part of a new table."""
        path = path or f"{self.path}-{uuid.uuid4().hex}"
        self.read().write.parquet(f"{path}/batch=-1")
        return EdgeTable(self.spark, path, self.keys)


class EntryTable:
    """IO-4 as a stream: entries appended with dense sequence numbers (use as foreachBatch)."""

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, text: str):
        self.spark, self.path, self.key, self.order, self.text = spark, path, key, order, text

    def add(self, rows: DataFrame, batch: int) -> None:
        from skein.sources.entries import append_entries

        known = None
        if batch:
            known = self.spark.read.parquet(self.path).where(F.col("batch") < batch)
        append_entries(rows, self.key, self.order, self.text, known).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("batch")


def deltas(rows: DataFrame) -> DataFrame:
    """TS-1 as a stream of (series, iteration, vne): the change since the row before; the last value
    of each series is the state."""

    def step(key, batches, state: GroupState):
        import pandas as pd

        rows = pd.concat(batches).sort_values("iteration")
        last = state.get[0] if state.exists else None
        before = [last, *rows["vne"].tolist()[:-1]]
        state.update((float(rows["vne"].iloc[-1]),))
        yield pd.DataFrame({"series": key[0], "iteration": rows["iteration"], "d_vne": [0.0 if b is None else v - b for v, b in zip(rows["vne"], before)]})

    kinds = dict(rows.dtypes)
    schema = f"series {kinds['series']}, iteration {kinds['iteration']}, d_vne double"
    return rows.groupBy("series").applyInPandasWithState(step, schema, "last double", "append", GroupStateTimeout.NoTimeout)


def early_convergence(rows: DataFrame, n: int = 5, most_variance: float = 0.01, least_slope: float = 0.05) -> DataFrame:
    """TS-7 as a stream of (series, iteration, vne, ee); the last n - 1 rows are the state."""

    def step(key, batches, state: GroupState):
        import numpy as np
        import pandas as pd

        rows = pd.concat(batches).sort_values("iteration")
        vne, ee = (list(x) for x in state.get) if state.exists else ([], [])
        out = []
        for v, e in zip(rows["vne"], rows["ee"]):
            vne, ee = [*vne, v][-n:], [*ee, e][-n:]
            out.append(len(vne) == n and bool(np.var(ee, ddof=1) < most_variance) and bool(np.polyfit(range(n), vne, 1)[0] > least_slope))
        state.update((vne[-n + 1 :], ee[-n + 1 :]))
        yield pd.DataFrame({"series": key[0], "iteration": rows["iteration"], "converging": out})

    kinds = dict(rows.dtypes)
    schema = f"series {kinds['series']}, iteration {kinds['iteration']}, converging boolean"
    return rows.groupBy("series").applyInPandasWithState(step, schema, "vne array<double>, ee array<double>", "append", GroupStateTimeout.NoTimeout)


def confirmed_transition(rows: DataFrame) -> DataFrame:
    """TS-8 as a stream of (series, iteration, correlation, h); the fold's state is the state."""

    def step(key, batches, state: GroupState):
        import json

        import pandas as pd

        rows = pd.concat(batches).sort_values("iteration")
        fold = json.loads(state.get[0]) if state.exists else {"seen": 0}
        out = []
        for c, h in zip(rows["correlation"], rows["h"]):
            out.append(confirm(fold, fold["seen"], c, h))
            fold["seen"] += 1
        state.update((json.dumps(fold),))
        yield pd.DataFrame({"series": key[0], "iteration": rows["iteration"], "confirmed": out})

    kinds = dict(rows.dtypes)
    schema = f"series {kinds['series']}, iteration {kinds['iteration']}, confirmed boolean"
    return rows.groupBy("series").applyInPandasWithState(step, schema, "fold string", "append", GroupStateTimeout.NoTimeout)


def hysteresis_state(rows: DataFrame, low: float = 2, high: float = 5) -> DataFrame:
    """TS-12 as a stream of (series, iteration, value); the present state is the state."""

    def step(key, batches, state: GroupState):
        import pandas as pd

        rows = pd.concat(batches).sort_values("iteration")
        now, out = state.get[0] if state.exists else "NORMAL", []
        for v in rows["value"]:
            now = "NORMAL" if v < low else "CRITICAL" if v >= high or now == "CRITICAL" else "OBSTRUCTED"
            out.append(now)
        state.update((now,))
        yield pd.DataFrame({"series": key[0], "iteration": rows["iteration"], "state": out})

    kinds = dict(rows.dtypes)
    schema = f"series {kinds['series']}, iteration {kinds['iteration']}, state string"
    return rows.groupBy("series").applyInPandasWithState(step, schema, "now string", "append", GroupStateTimeout.NoTimeout)
