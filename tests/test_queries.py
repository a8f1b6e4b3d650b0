"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, normal

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    yield con
    con.close()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toArrow()
    if name not in SQL:
        assert got.num_rows > 0
        return
    want = con.execute(SQL[name]).to_arrow_table()
    assert {f.name: str(f.type) for f in got.schema} == {f.name: str(f.type) for f in want.schema}
    a, b = normal(got.to_pandas()), normal(want.to_pandas())
    assert len(a) == len(b)
    assert a.equals(b)


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["dataset", "month", "n_tokens", "n_bytes", "bits", "bpb", "bpt"]
    assert rows.count() > 0
