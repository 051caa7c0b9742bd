"""Every registered query with a twin gives the twin's rows."""

import glob
import os

import duckdb
import pytest

from textloom.plans import registry

SF = "/root/testdata/sf0.001"


def rows(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object)
    return columns, sorted(map(repr, plain.where(plain.notna(), None).values.tolist()))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_twin(spark, tables, name):
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(tables.sql(registry.oracle_sql()[name]).df())
