"""Every registered query with SQL gives what DuckDB gives; the others give rows with a stable schema."""

import math
import os
from collections import Counter

import pytest

DATA = os.environ.get("CARDMILL_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

from cardmill import catalog  # noqa: E402


def canonical(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(canonical, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    mine = Counter(tuple(canonical(r[c]) for c in columns) for r in df.collect())
    con = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == columns
    theirs = Counter(tuple(canonical(r[names.index(c)]) for c in columns) for r in con.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    df = catalog.queries()[name](spark, DATA)
    df.collect()
    assert len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
