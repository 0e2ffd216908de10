"""Every query with SQL gives the same rows as DuckDB; those without run."""

import duckdb
import pandas as pd
import pytest

import lectern.catalog as catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
        return None
    if isinstance(x, str | bytes | bool):
        return x
    if hasattr(x, "__iter__"):
        return tuple(map(plain, x))
    if isinstance(x, float) or type(x).__name__.startswith("float"):
        return round(float(x), 9)
    return int(x) if hasattr(x, "__int__") else str(x)


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(map(plain, r)) for r in df[cols].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE_SQL:
        want = duck.execute(catalog.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
