"""Every query with SQL gives the rows that its SQL gives."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from lumora.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{float(v):.6g}" if isinstance(v, float) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, sf_dir, duck, name):
    assert rows(registry.QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.execute(registry.ORACLES[name]).df())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
