import duckdb
import pytest

from glyphmill.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, sf, name):
    got = QUERIES[name](spark, sf)
    rows = sorted(map(tuple, got.select(sorted(got.columns)).collect()), key=str)
    assert rows
    if name in SQL:
        con = duckdb.connect()
        for table in ("documents", "conversations"):
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
        expected = con.sql(SQL[name])
        order = sorted(expected.columns)
        assert rows == sorted(con.sql(f"SELECT {', '.join(order)} FROM ({SQL[name]})").fetchall(), key=str)
