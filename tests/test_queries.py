"""Every registered query of the core against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from routeloom.plans import code_queries, scenario_queries, trace_queries, value_queries  # noqa: F401
from routeloom.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def oracle():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, SF).toArrow()
    want = oracle.execute(SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    names = sorted(got.column_names)
    rows = lambda t: sorted((tuple(r[n] for n in names) for r in t.select(names).to_pylist()), key=repr)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_bench_times_the_route_merge():
    import bench

    assert "merge_routes" in bench.HEADLINE
