"""Every registered query with an oracle: Spark result == DuckDB SQL on the
small fixture (the driver runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as entry
from scripts.oracle_check import compare, duck

from conftest import SF_SMALL

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    drows = cur.fetchall()
    err = compare(rows, df.columns, drows, [d[0] for d in cur.description])
    assert err is None, err


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert len(df.collect()) >= 0 and "column_name" in df.columns
