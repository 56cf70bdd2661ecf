"""Registered queries of the training-data operators against their SQL in DuckDB."""

import duckdb
import pytest

from loomkv.llm import queries as q

SF = "/root/testdata/sf0.001"
SQL = q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = q.queries()[name](spark, SF)
    want = con.execute(SQL[name])
    columns = [x[0] for x in want.description]
    at = sorted(got.columns)
    assert at == sorted(columns)
    rows = sorted(tuple(str(r[c]) for c in at) for r in got.collect())
    assert rows == sorted(tuple(str(r[columns.index(c)]) for c in at) for r in want.fetchall()) and rows
