"""Every registered graph query against its SQL, at the smallest scale."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tessera.plans import oracles, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def sorted_frame(frame: pd.DataFrame) -> pd.DataFrame:
    columns = sorted(frame.columns)
    return frame[columns].sort_values(columns, ignore_index=True)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_WHEN_run_SHOULD_equal_sql(spark, duck, name):
    want, got = sorted_frame(duck.sql(oracles.oracle_sql()[name]).df()), sorted_frame(queries.queries()[name](spark, DATA).toPandas())
    want, got = want.astype(object).where(want.notna(), None), got.astype(object).where(got.notna(), None)
    pd.testing.assert_frame_equal(want, got, check_dtype=False, rtol=0, atol=1e-9)


def test_queries_WHEN_listed_SHOULD_have_sql_but_for_embedded_text():
    assert set(queries.queries()) - set(oracles.oracle_sql()) == {"synonym_eval", "embedded_corpus"}


def test_entry_WHEN_called_SHOULD_give_hubs(spark):
    assert entry.entry(spark).columns == ["id", "name", "category", "deg"] and entry.entry(spark).count() == 20
