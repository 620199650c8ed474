"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate)."""

import duckdb
import pytest

from conftest import SF01

import __spark_entry__ as E
from tools.oracle_check import TABLES, canon

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF01)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert df.columns
        return
    cur = con.execute(ORACLE[name])
    sc, sr = canon(df.columns, rows)
    dc, dr = canon([d[0] for d in cur.description], cur.fetchall())
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr
