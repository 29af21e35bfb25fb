"""The found cases against their SQL on the smallest tables."""

import os
from collections import Counter

import pytest

from cardmill.llm import queries

DATA = os.environ.get("CARDMILL_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    con = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == columns
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[names.index(c)] for c in columns) for r in con.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
