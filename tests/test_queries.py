"""Every query against its SQL in DuckDB over the smallest tables."""

import decimal
import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from foliograph.plans import queries
from foliograph.plans.bindings import TABLES


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    out = queries.QUERIES[name](spark, sf)
    columns = sorted(out.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in out.collect())
    cursor = duck.execute(queries.SQL[name])
    named = [d[0] for d in cursor.description]
    assert sorted(named) == columns
    at = [named.index(c) for c in columns]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
