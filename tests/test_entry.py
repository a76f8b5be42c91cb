"""The registered queries against DuckDB over the smallest tables."""

from __future__ import annotations

import datetime
import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.plans import direct, relational

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")

CHECKED = ["flagship_top_customers", "null_logic", "join_full", "join_using", "correlated_subquery", "agg_median_mode", "grouping_sets", "win_first_last_nth", "qualify_top1", "order_nulls_default", "except_all", "cte_recursive", "pivot_sql", "fn_cast_dates", "fn_date_diff", "fn_null", "api_pivot_table", "dml_merge", "csv_round_trip"]


def _plain(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return None
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return str(pd.Timestamp(v))
    if isinstance(v, numbers.Real) and not isinstance(v, (bool, np.bool_)):
        return str(round(float(v), 6))
    return str(v)


def _rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(_plain, r)) for r in frame.astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_duckdb(spark, duck, name):
    queries, sql = relational.QUERIES | direct.QUERIES, relational.ORACLE_SQL | direct.ORACLE_SQL
    mine, theirs = queries[name](spark, SF).toPandas(), duck.sql(sql[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert _rows(mine) == _rows(theirs)


def test_every_query_has_a_check():
    assert set(relational.QUERIES) == set(relational.ORACLE_SQL) and set(direct.QUERIES) == set(direct.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
