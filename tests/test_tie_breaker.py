"""QE-4 on rows that its SQL orders and on rows that it leaves open."""

import itertools
import random

import duckdb

from skein import plans

NAME = "qe4_tie_breaker_value"
COLUMNS = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string"


def found(spark, rows, path):
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("overwrite").parquet(f"{path}/lineitem.parquet")
    return sorted(map(tuple, plans.queries()[NAME](spark, path).collect()), key=str)


def test_nulls_and_odd_numbers_as_in_sql(spark, tmp_path):
    r = random.Random(1)
    quantity = [None, float("nan"), float("inf"), float("-inf"), -0.0, -5.0, 3.0, 12.0, 25.0, 1e300]
    orders = [r.choice([None, 1, 2, 3, 4, 5, 6]) for _ in range(60)]
    # the first row of an order has no part, so that no tie is left open
    rows = [(o, None if o not in orders[:n] else n, r.choice([None, -5, -4, -3, 0, 1, 2]), 1, r.choice(quantity), r.choice([None, "R", "A", "N", "N"])) for n, o in enumerate(orders)]
    rows += [(7, None, 0, 1, 3.0, "A"), (7, 5, 0, 1, 3.0, "R")]
    got = found(spark, rows, str(tmp_path))
    want = duckdb.sql(plans.oracle_sql()[NAME].replace("from lineitem", f"from '{tmp_path}/lineitem.parquet/*.parquet'")).fetchall()
    assert got == sorted(want, key=str)


def test_open_ties_do_not_follow_the_order_of_rows(spark, tmp_path):
    rows = [(1, 5, 0, 1, 3.0, "A"), (1, 5, 0, 1, 4.0, "R"), (1, 5, 0, 1, 5.0, "N")]
    assert {tuple(found(spark, list(p), str(tmp_path))) for p in itertools.permutations(rows)} == {((1, 1, 1),)}
