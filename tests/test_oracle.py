"""Every query with a SQL twin equals DuckDB on the smallest fixture."""

import math

import pandas as pd
import pytest

import __spark_entry__ as E

SMALL = "/root/testdata/sf0.001"
SQL = E.oracle_sql()


def _norm(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None  # pandas shows a null number as NaN
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, pd.Timestamp):
        return str(v)
    return v


def _rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)), key=repr)


def test_every_query_registered_with_known_sql_keys():
    qs = E.queries()
    assert set(SQL) <= set(qs)
    assert len(qs) >= 70


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_duckdb(spark, duck, name):
    got = E.queries()[name](spark, SMALL).toPandas()
    exp = duck.execute(SQL[name]).df()
    assert _rows(got) == _rows(exp)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "escalate" in df.columns
