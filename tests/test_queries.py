"""Every query against its SQL in DuckDB, on the smallest tables."""

import os
from numbers import Number

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from quillon.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(frame):
    names = sorted(frame.columns)
    out = []
    for row in frame[names].itertuples(index=False):
        out.append(tuple(None if pd.isna(x) else float(x) if isinstance(x, Number) else str(x) for x in row))
    return names, sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_matches_sql(spark, duck, name):
    assert canon(core.QUERIES[name](spark, SF).toPandas()) == canon(duck.execute(core.SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_query_without_sql_runs(spark, name):
    assert core.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert {r["dim"] for r in __spark_entry__.entry(spark).collect()} == {"Video Quality", "Motion & Interaction", "Prompt Alignment", "overall"}
