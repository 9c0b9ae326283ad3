"""Physical plans: what is shuffled, pushed down and joined."""

from __future__ import annotations

import os
import re

import pytest

import __spark_entry__ as driver
from kerbflow.plans.catalog import QUERIES

FOLDER = os.environ.get("KERBFLOW_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
STORING = {"stream_hourly", "stream_corrected", "stored_rollups", "stored_two_sources",
           "stored_weekday_hour", "stored_snapshot", "unified_after_correction",
           "annual_after_correction"}
BATCH = sorted(set(QUERIES) - STORING)


def plan(spark, name: str) -> str:
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return driver.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def shuffles(text: str) -> int:
    return len(re.findall(r"Exchange (?:hash|range)partitioning", text))


@pytest.mark.parametrize("name", BATCH)
def test_no_product_join_and_no_row_udf(spark, name):
    text = plan(spark, name)
    assert "Cartesian" not in text and "NestedLoop" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


@pytest.mark.parametrize("name", [
    "rollup_daily_company", "rollup_daily_zone", "rollup_hourly", "rollup_weekday_hour",
    "rollup_measures", "rollup_zone_backfill", "hex_density", "zone_centroids",
])
def test_one_shuffle(spark, name):
    assert shuffles(plan(spark, name)) == 1


@pytest.mark.parametrize("name", ["time_parts", "link_discovery"])
def test_no_shuffle(spark, name):
    assert shuffles(plan(spark, name)) == 0


def test_time_range_and_codes_reach_the_scan(spark):
    text = plan(spark, "rollup_day_location")
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert "GreaterThanOrEqual(ts,2024-01-01" in pushed and "LessThan(ts,2024-02-01" in pushed
    assert "In(event_type" in pushed
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in text


def test_source_slices_reach_the_scan(spark):
    scans = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", plan(spark, "unified_daily_company"))
    assert len(scans) == 4 and all("(o_orderdate" in s for s in scans)


def test_trips_are_read_with_the_needed_columns_only(spark):
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz>" in plan(spark, "resample_month")
    assert "ReadSchema: struct<user_id:bigint" not in plan(spark, "heatmap")


def test_names_are_joined_after_counting(spark):
    text = plan(spark, "rollup_daily_zone")
    join, count = text.index("BroadcastHashJoin"), text.index("partial_count")
    assert join < count


def test_bounds_reuse_the_rollup(spark):
    df = driver.queries()["growth_stats"](spark, FOLDER)
    df.toArrow()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in final


def test_merging_adds_no_shuffle_to_those_of_the_sources(spark):
    text = plan(spark, "unified_daily_company")
    assert shuffles(text) == 4 and "WindowGroupLimit" in text


def test_priority_filter_limits_groups_before_a_shuffle(spark):
    assert plan(spark, "event_calendar").count("WindowGroupLimit") == 2
