"""Every registered graph query against its SQL, on the smallest tables."""

import datetime

import duckdb
import pytest

from loomgraph.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", list(QUERIES))
def test_equals_sql(spark, sf, oracle, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    r = oracle.sql(ORACLE_SQL[name])
    assert sorted(r.columns) == names
    at = [r.columns.index(n) for n in names]
    got = sorted((tuple(plain(x[n]) for n in names) for x in df.collect()), key=repr)
    assert got == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_columns_and_filters_reach_the_scan(spark, sf):
    plan = QUERIES["q_flagship_top_customers"](spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,100000.0)" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in plan
