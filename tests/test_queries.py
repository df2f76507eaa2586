"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from sievework.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "-"
        if isinstance(v, float):
            return f"{v:.9g}"
        if hasattr(v, "year"):
            return str(pd.Timestamp(v))
        return str(v.item() if hasattr(v, "item") else v)

    names = sorted(df.columns)
    return sorted(tuple(cell(v) for v in r) for r in df[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, data, db, name):
    got, want = QUERIES[name](spark, data).toPandas(), db.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
