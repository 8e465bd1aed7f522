"""The pipeline against plain Python, stage by stage."""

import brute
import duckdb

import corpus_pipeline
from skein.llm import quality, toxicity

SF = "/root/testdata/sf0.001"


def test_run_equals_stages_in_plain_python(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()

    def keeps(text):
        m = dict(zip([x.split()[0] for x in quality.MEASURES.split(", ")], quality.measure(text)))
        rules = [quality.RULES[r] for r in quality.WEB.rules]
        return not any(eval(rule, {}, m) for rule in rules)

    docs = [(i, t) for i, t in docs if keeps(t)]
    kept = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(kept, spark.read.parquet(f"{SF}/labels.parquet"))
    docs = [(i, t) for i, t in docs if model.score(t) < 0.5]
    docs = [(i, t) for i, (_, _, t) in brute.line_dedup(docs).items()]
    parts = brute.components({i: brute.simhash(t) for i, t in docs})
    docs = [(i, t) for i, t in docs if parts[i] == i]
    want = {}
    for (i, _), ids in zip(docs, brute.tokenizer([t for _, t in docs], "byte_bpe_50k.json")):
        want[i] = brute.crc([*ids, 0]) if len(ids) < 2048 else len(ids) + 1
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert {i: (r[0].ids_crc32 if len(r) == 1 else sum(x.length for x in r)) for i, r in got.items()} == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


LONG = "this is a line that many of the documents share with each other"
BODY = "a text of its own about {} and how the ships at sea weathered {} storms in the year {}"
COLUMNS = "doc_id long, text string, n_lines int, score double, predicted int, failed int, _row int, text_hash int, row int, _c0 int, stay_id string"


def odd(spark):
    """Null and repeated ids, null, empty and very long texts, repeated rows, clashing columns."""
    long = " ".join(f"word{i} of a very long text" for i in range(40_000))  # a megabyte
    bodies = [BODY.format(w, w * 2, w * 3) for w in ("apples", "kettle", "zinc", "violet", "osprey", "lichen")]
    rows = [(1, bodies[0]), (1, bodies[0]), (1, bodies[1]), (None, bodies[2]), (None, None), (2, ""), (3, long), (4, bodies[3] + "\n" + LONG)]
    rows += [(k, f"{bodies[4]} {k}\n{LONG}\n{bodies[5]} {k} {k}") for k in (5, 6, 7, 8)]
    return spark.createDataFrame([(i, t, 7, 0.25, 1, 3, 4, 5, 6, 8, "x") for i, t in rows], COLUMNS), len(rows)


def test_stages_on_odd_tables(spark):
    docs, n = odd(spark)
    rest = docs.columns[2:]
    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 1, 1, 4, None]  # the others are empty or repeat windows
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert clean.columns == docs.columns and 0 < clean.count() <= n
    lines = corpus_pipeline.dedup_lines(spark, docs, SF)
    assert lines.columns == docs.columns and lines.count() == n
    with_line = {r.doc_id for r in lines.where(lines.text.contains(LONG)).collect()}
    assert with_line == {8}
    near = corpus_pipeline.near_dedup(spark, docs, SF)
    assert near.columns == docs.columns
    ids = sorted((r.doc_id for r in near.collect()), key=str)
    assert len([i for i in ids if i is None]) == 1 and ids.count(1) in (1, 2) and 2 in ids and 3 in ids
    for out in (kept, clean, lines, near):
        assert set(map(tuple, out.select(*rest).collect())) == {(7, 0.25, 1, 3, 4, 5, 6, 8, "x")}
    packed = corpus_pipeline.best_fit_packing(spark, docs, SF).collect()
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 2048
    assert sum(r.length for r in packed if r.doc_id == 3) > 200_000
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
