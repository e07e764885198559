"""Every registered query that has SQL gives the SQL's rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tabweave import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if glob.glob(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def canonical(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "NULL" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else f"{v:.9g}" if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(name, spark, sf_dir, db):
    got, want = canonical(catalogue.QUERIES[name](spark, sf_dir).toPandas()), canonical(db.sql(catalogue.ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    assert got.equals(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(catalogue.QUERIES) <= set(entry.queries())
