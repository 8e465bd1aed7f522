"""Each registered query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from skein import plans

SF = "/root/testdata/sf0.001"
#: Queries that take many rounds; they are held against brute force in other tests.
SLOW = {"ga1_communities", "ga4_betweenness", "ga10_gap_path_length"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    text = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(set(plans.oracle_sql()) - SLOW))
def test_query_matches_sql(spark, duck, name):
    got = plans.queries()[name](spark, SF)
    want = duck.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_every_query_is_registered_once():
    assert set(plans.oracle_sql()) <= set(plans.queries())
