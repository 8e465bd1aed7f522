"""The batch search in blocks against plain comparison of all pairs, on odd vectors and large groups of copies."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import vectors as V


def plain(rows, queries, floor, k):
    near = rows.join(queries, F.lit(True)).withColumn("similarity", V.cosine(F.col("v"), F.col("qv"))).where(F.col("similarity") >= floor)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = [(i, rng.normal(size=6).tolist()) for i in range(60)] + [(100 + i, [1.0, 2.0, 0.5, 0.0, -1.0, 3.0]) for i in range(40)]
    data += [(200 + i, [2.0 ** (i % 3) * x for x in (1.0, 2.0, 0.5, 0.1, -1.0, 3.0)]) for i in range(12)]
    data += [(300, None), (301, [0.0] * 6), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (304, [1e200] * 6), (305, [1.0, 2.0]), (306, []), (307, [float("inf")] + [1.0] * 5)]
    return spark.createDataFrame(data, "id long, v array<double>")


@pytest.mark.parametrize("floor", [0.1, -1.0])
def test_search_is_that_of_all_pairs(spark, rows, monkeypatch, floor):
    monkeypatch.setattr(V, "BLOCK_NUMBERS", 100)
    monkeypatch.setattr(V, "ROW_NUMBERS", 200)
    monkeypatch.setattr(V, "PRODUCTS", 50)
    queries = rows.where("id % 4 = 0 or id > 300").select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    text = lambda df: sorted(map(str, df.collect()))
    assert text(V.similarity_search_batch(rows, queries, floor, 3, "v", "id")) == text(plain(rows, queries, floor, 3))


def test_pairs_are_compared_in_products_of_matrices(rows):
    queries = rows.select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    plan = V.similarity_search_batch(rows, queries, 0.1, 3, "v", "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_copies_leave_k_rows_a_query():
    same = np.tile(np.array([[1.0, 2.0, 3.0]]), (5000, 1))
    q, r, similarity = V._best_of_block(same[:7], same, 0.1, 3)
    assert r.tolist() == [0, 1, 2] * 7 and q.tolist() == np.repeat(np.arange(7), 3).tolist()


def test_questions_have_two_entries_where_copies_come_before_themselves(spark, tmp_path):
    from skein import plans

    data = [(i, [1.0, 2.0, 3.0], 0) for i in range(1, 9)] + [(100, [1.0, 2.0, 3.0], 0)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = plans.queries()["ga18_question_context"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(100, "1,2", "context-supported")]
