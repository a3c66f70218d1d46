"""Every query with SQL against DuckDB; the others give rows with a stable schema."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tidewright.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(frame: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, (bool,)) or type(v).__name__ == "bool":
            return str(bool(v))
        return str(round(float(v), 6)) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted(tuple(cell(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, db, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), db.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_are_pruned(spark):
    plan = QUERIES["track_quality"](spark, DATA)._jdf.queryExecution().toString()
    assert "l_shipdate" not in plan.split("ReadSchema")[-1]
    assert plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") <= 2
