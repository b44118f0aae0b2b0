"""Every registered query runs, and equals its DuckDB SQL where it has some."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from variform.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(x):
    if x is None or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    x = x.item() if hasattr(x, "item") else x
    return round(float(x), 6) if isinstance(x, int | float) and not isinstance(x, bool) else x


def rows(df):
    return sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE:
        want = duck.sql(catalog.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
