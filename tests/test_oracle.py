"""Every registered query of the engine against its SQL in DuckDB."""

import duckdb
import pytest

from loomkv.plans import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
SQL = q.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def in_order(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [sorted(columns), sorted([tuple(str(r[i]) for i in at) for r in rows])]


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, duck, name):
    got = q.queries()[name](spark, SF)
    rows = got.collect()
    if name in SQL:
        want = duck.execute(SQL[name])
        assert in_order(got.columns, rows) == in_order([x[0] for x in want.description], want.fetchall())
    else:
        assert rows
