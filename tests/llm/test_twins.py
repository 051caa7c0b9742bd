"""The operators that SQL can express give the rows of their SQL."""

import glob
import os

import duckdb
import pytest

from textloom.llm import queries, sql

SF = "/root/testdata/sf0.001"


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(repr([r[k] for k in order]) for r in found)


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    mine, own = queries.queries()[name](spark, SF), con.sql(sql.oracle_sql()[name])
    assert rows(mine.columns, mine.collect()) == rows(own.columns, own.fetchall())
