"""The operators that have SQL, against it on the smallest tables."""

import duckdb
import pytest

from loamworks import llm

from ..test_queries import SF, TABLES, rows


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = llm.queries()[name](spark, SF).toPandas(), con.sql(llm.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
