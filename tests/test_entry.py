"""The driver's contract: queries, and their SQL run by DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from millrace import catalog_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def values(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple("NULL" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog_queries.QUERIES))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    if name in catalog_queries.SQL:
        assert values(got) == values(duck.execute(catalog_queries.SQL[name]).fetchdf())
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
