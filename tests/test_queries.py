"""Every registered query against its DuckDB twin, and the driver contract."""

import glob
import os

import duckdb
import pytest
from fixture_data import DATA

import __spark_entry__ as contract

QUERIES = contract.queries()
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def table(frame):
    columns = sorted(frame.columns)
    return frame[columns].sort_values(columns).reset_index(drop=True)


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["vec_id", "code"]
    rows = df.collect()
    assert rows and all(len(r.code) == 8 for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    mine = QUERIES[name](spark, DATA).toPandas()
    assert len(mine)
    if name not in ORACLES:
        return
    theirs = duck.execute(ORACLES[name]).df()
    mine, theirs = table(mine), table(theirs)
    assert list(mine.columns) == list(theirs.columns)
    assert len(mine) == len(theirs)
    for column in mine.columns:
        same = (mine[column] == theirs[column]) | (mine[column].isna() & theirs[column].isna())
        assert same.all(), f"{column}: {(~same).sum()} values differ"
