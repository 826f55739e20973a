import duckdb
import pytest

from docveil.llm import queries


@pytest.mark.parametrize("name", ["op5_parity_join", "op9_warc_chunks"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS FROM '/root/testdata/sf0.01/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, "/root/testdata/sf0.01")
    assert want.columns == got.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
