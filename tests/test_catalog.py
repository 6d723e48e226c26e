"""Every registered query runs on sf0.001 and matches its DuckDB twin."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import TABLES, close, frame_rows  # noqa: E402
from shelfcast.plans.catalog import QUERIES as CATALOG  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0


def test_every_query_has_a_twin():
    assert set(CATALOG) <= set(entry.queries())
    assert set(CATALOG) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query_matches_oracle(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    sc, sr = frame_rows(got)
    dc, dr = frame_rows(want)
    assert sc == dc
    assert len(sr) == len(dr)
    for a, b in zip(sr, dr):
        assert all(close(x, y) for x, y in zip(a, b)), (a, b)
