"""Every catalogued query against its SQL on the test tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as driver
from kerbflow.plans.catalog import ORACLES, QUERIES
from tests.compare import connect, differences

FOLDER = os.environ.get("KERBFLOW_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = driver.queries()[name](spark, FOLDER).toArrow()
    want = duck.sql(driver.oracle_sql()[name]).to_arrow_table()
    assert differences(got, want) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    got = driver.queries()[name](spark, FOLDER).toPandas()
    assert len(got) > 0
    assert (got["trips_forecast"] >= 0).all()
    assert set(got["model"]) == {"Regression + seasonality"}


def test_entry(spark):
    heat = driver.entry(spark)
    assert heat.columns[:2] == ["weekday_num", "weekday"] and len(heat.columns) == 26
    assert heat.count() == 7
