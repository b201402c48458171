"""Every registered query against its SQL, over whole tables."""

import os

import pytest
from compare import differences, duck

import __spark_entry__ as entry

SMALL = os.environ.get("GRAPHLOAM_SMALL", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_its_sql(spark, con, name):
    assert differences(spark, con, entry.queries()[name], SQL[name], SMALL) == ""


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = entry.queries()[name](spark, SMALL)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
