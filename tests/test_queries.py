"""Every query with SQL equals DuckDB on the smallest tables; the others run and have rows."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from cartulary.plans import catalog


def rows(df):
    cols = sorted(df.columns)

    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, (float, np.floating)) and np.isnan(v)):
            return None
        if isinstance(v, (float, np.floating)):
            return round(float(v), 5)
        if isinstance(v, (bool, np.bool_, int, np.integer)):
            return float(v)
        return v

    return sorted((tuple(plain(v) for v in r) for r in df[cols].astype(object).values.tolist()), key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"create view {t.split('.')[0]} as select * from '{sf}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, sf, duck, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
