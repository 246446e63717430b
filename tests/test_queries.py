"""Every query with SQL gives the same rows as DuckDB on the smallest tables; the others run."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from kindra.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(df):
    values = df[sorted(df.columns)].itertuples(index=False)
    return sorted(repr([None if x is None or x is pd.NA or x != x else x.item() if hasattr(x, "item") else x for x in row]) for row in values)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
