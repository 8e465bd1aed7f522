"""Folds of metric series, in batch and as streams; vectors and check logs."""

import random

import json

import numpy as np
import pytest

from skein.operators import entropy, series, vectors
from skein.sources import run_log
from skein.streaming import incremental


def test_regime_classes(spark):
    rows = [("calm", i, 0.1, 0.5, 1) for i in range(20)] + [("wild", i, 1.5 * (-1) ** i, 0.9 * (-1) ** i, 1) for i in range(20)]
    df = spark.createDataFrame(rows, "series string, iteration int, cdp double, correlation double, growth int")
    last = {r.series: r.regime for r in series.regime(df).where("iteration = 19").collect()}
    assert last == {"calm": "stable", "wild": "critical"}
    first = {r.regime for r in series.regime(df).where("iteration < 9").collect()}
    assert first == {"nascent"}


def test_hysteresis(spark):
    values = [0, 3, 6, 4, 3, 1, 3, 5, 2, 1.9]
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(values)], "series string, iteration int, value double")
    got = [r.state[0] for r in series.hysteresis_state(df, "value").orderBy("iteration").collect()]
    assert "".join(got) == "NOCCCNOCCN"


def test_confirmed_once(spark):
    corr = [0.7] * 5 + [-0.7] * 8
    df = spark.createDataFrame([("s", i, c, 2) for i, c in enumerate(corr)], "series string, iteration int, correlation double, h int")
    got = [r.iteration for r in series.confirmed_transition(df).where("confirmed").collect()]
    assert got == [8]


def run_stream(spark, tmp_path, df, step, name):
    """df written as two files in order, read as a stream until there is no more."""
    df.where("iteration < 7").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df.where("iteration >= 7").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = step(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(map(tuple, spark.table(name).collect()))


def test_streams_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(s, i, float(rng.normal()), float(rng.normal()), float(rng.uniform(0, 8))) for s in ("a", "b") for i in range(14)]
    df = spark.createDataFrame(rows, "series string, iteration int, vne double, ee double, value double")
    batch = lambda d, *c: sorted(map(tuple, d.select("series", "iteration", *c).collect()))
    got = run_stream(spark, tmp_path / "1", df, incremental.deltas, "s1")
    assert got == [(s, i, pytest.approx(d)) for s, i, d in batch(series.deltas(df, "vne"), "d_vne")]
    assert run_stream(spark, tmp_path / "2", df, incremental.hysteresis_state, "s2") == batch(series.hysteresis_state(df, "value"), "state")
    early = lambda d: incremental.early_convergence(d, most_variance=2.0)
    assert run_stream(spark, tmp_path / "3", df, early, "s3") == batch(series.early_convergence(df, most_variance=2.0), "converging")


def test_edge_and_entry_tables(spark, tmp_path):
    toks = spark.createDataFrame([(d, p, t) for d in range(4) for p, t in enumerate("abca")], "doc_id long, pos int, token string")
    table = incremental.EdgeTable(spark, str(tmp_path / "edges"), ["doc_id"])
    for batch in (0, 1, 1):  # the second batch is run twice
        table.add(toks.where(f"doc_id % 2 = {batch}"), batch)
    from skein.operators.graph import cooccurrence_edges

    want = sorted(map(tuple, cooccurrence_edges(toks, ["doc_id"]).collect()))
    assert sorted(map(tuple, table.read().collect())) == want
    assert sorted(map(tuple, table.compact(str(tmp_path / "one")).read().collect())) == want
    docs = spark.createDataFrame([(i, "k", f"text {i}") for i in range(6)], "doc_id long, source string, text string")
    entries = incremental.EntryTable(spark, str(tmp_path / "entries"), "source", "doc_id", "text")
    entries.add(docs.where("doc_id < 3"), 0)
    entries.add(docs.where("doc_id >= 3"), 1)
    assert [r.seq for r in entries.read().orderBy("doc_id").collect()] == list(range(6))


def test_run_log(spark, tmp_path):
    check = {"kind": "pair", "blocks": ["A"], "formulas": ["p(x)"], "verdict": "sat", "note": None}
    lines = [json.dumps({"type": "logic_check_log", "checkLog": [check, {"kind": "x"}]}), "", "{broken", json.dumps({"type": "tool", "output": json.dumps({"checkLog": [check]})})]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    assert [r.verdict for r in run_log.read_run_log(spark, str(tmp_path / "log.jsonl")).collect()] == ["sat", "sat"]
    run_log.write_run_log(spark.createDataFrame([("a", 1), ("b", 2)], "type string, n int"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_embedding_entropy_and_directions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 4)) * [4, 2, 1, 0.5]
    df = spark.createDataFrame([("g", i, v.tolist()) for i, v in enumerate(x)], "g string, id int, v array<double>")
    p = np.linalg.eigvalsh(x.T @ x / 30)
    p = p / p.sum()
    assert entropy.embedding_entropy(df, "g", "v").first()["entropy"] == pytest.approx(-(p * np.log(p)).sum())
    got = np.array([r.direction for r in vectors.concept_subspace(df, "g", "v", 2).orderBy("rank").collect()])
    _, _, vt = np.linalg.svd(x - x.mean(axis=0))
    assert np.abs((got * vt[:2]).sum(axis=1)) == pytest.approx([1, 1])


def test_closed_forms_equal_folds(spark):
    """TS-8 and TS-9 row by row, against the windows."""
    r = random.Random(11)
    rows = [(s, i, r.choice([-0.5, 0.0, 0.4, 0.6]), r.randint(0, 4), r.choice([0.0, 0.1, 2.0]) * r.random(), r.randint(0, 1)) for s in range(12) for i in range(60)]
    df = spark.createDataFrame(rows, "series int, iteration int, correlation double, h int, cdp double, growth int")
    want = set()
    for s in range(12):
        state = {}
        want |= {(s, i) for _, i, c, h, _, _ in (x for x in rows if x[0] == s) if incremental.confirm(state, i, c, h)}
    assert want and {(x.series, x.iteration) for x in series.confirmed_transition(df).where("confirmed").collect()} == want
    features = {(x.series, x.iteration): x for x in series.regime_features(df).collect()}
    got = {(x.series, x.iteration): x.regime for x in series.regime(df).collect()}
    for s in range(12):
        now, wait, same = "nascent", None, 0
        for i in range(60):
            x = features[s, i]
            if x.status == "measured":
                kind = "critical" if x.cdp_variance > 0.5 and x.correlation_std > 0.8 else "stable" if x.cdp_variance < 0.2 and x.correlation_std < 0.3 and x.recent_growth > 0 else "transitioning"
                same = same + 1 if kind == wait else 1
                wait = kind
                now = kind if same >= 5 else now
            assert got[s, i] == now
