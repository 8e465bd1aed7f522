"""The near_dedup stage on null and repeated ids: one row a group, no group lost."""

from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import simhash

A, B, C = ("the quick brown fox jumps over the lazy dog and runs away", "a wholly other text about ships at sea in heavy weather tonight", "nothing here is like the rest, it stands by itself in the corner")


def stays(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.near_dedup(spark, docs, None)
    assert found.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in found.collect()), key=str)


def test_null_ids_stay_where_their_group_has_no_other(spark):
    assert stays(spark, [(None, A), (None, B), (3, B), (None, C), (None, C)]) == sorted([(None, A), (3, B), (None, C)], key=str)


def test_repeated_ids_leave_one_row_a_group(spark):
    # 2 stands for its own group with B, but its row of A belongs to the group of 1.
    assert stays(spark, [(1, A), (2, A), (2, B), (2, B), (2, B.upper()), (5, C), (5, C), (6, None), (6, "")])[:2] == [(1, A), (2, stays(spark, [(2, B), (2, B.upper())])[0][1])]
    got = stays(spark, [(1, A), (2, A), (2, B), (2, B), (5, C), (5, C), (6, None), (6, "")])
    assert [i for i, _ in got] == [1, 2, 5, 6] and got[:3] == [(1, A), (2, B), (5, C)]


def test_links_broadcast_no_exploded_table(spark, tmp_path):
    """A table of few bytes becomes 34 rows a fingerprint, whatever Spark takes its size to be."""
    spark.range(1000).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_path}/fps")
    found = simhash.links(spark.read.parquet(f"{tmp_path}/fps"))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
