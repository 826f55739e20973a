import math

import duckdb
import pytest

from docveil.plans.registry import QUERIES

DIR = "/root/testdata/sf0.01"


def plain(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", [k for k, (_, sql) in QUERIES.items() if sql])
def test_against_sql(spark, name):
    query, sql = QUERIES[name]
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents benchmark conversations labels".split():
        con.sql(f"CREATE VIEW {t} AS FROM '{DIR}/{t}.parquet'")
    got = query(spark, DIR)
    columns = sorted(got.columns)
    want = con.sql(sql)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str) == expected


@pytest.mark.parametrize("name", [k for k, (_, sql) in QUERIES.items() if not sql])
def test_runs(spark, name):
    QUERIES[name][0](spark, "/root/testdata/sf0.001").collect()
