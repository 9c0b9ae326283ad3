"""Rollups and source merging on literal rows."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kerbflow.operators import rollup, unify
from kerbflow.operators.unify import Source

D = dt.date(2018, 10, 5)
ZONES = [(1, "Queens", "Astoria"), (2, "Bronx", "Belmont")]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def trips(spark):
    t = dt.datetime
    return spark.createDataFrame(
        [(t(2024, 1, 1, 5), "a", 1, 2.0, True), (t(2024, 1, 1, 5), "a", 2, None, False),
         (t(2024, 1, 1, 6), "a", 9, None, False), (t(2024, 1, 8, 5), "b", None, None, True)],
        "pickup_datetime timestamp_ntz, company string, location_id bigint, tips double, "
        "shared_request_flag boolean",
    )


def test_five_grains(spark):
    zones = spark.createDataFrame(ZONES, "location_id bigint, borough string, zone string")
    grains = rollup.five_grains(rollup.base_rollup(trips(spark)), zones)
    assert rows(grains["daily_by_company"], "company", "trips", "tips", "shared_requests") == [
        ("a", 3, 2.0, 1), ("b", 1, 0.0, 1)
    ]
    assert rows(grains["daily_by_borough"], "company", "borough", "trips") == [
        ("a", "Bronx", 1), ("a", "Queens", 1), ("a", None, 1), ("b", None, 1)
    ]
    assert rows(grains["weekday_hour_by_company"], "weekday", "hour", "company", "trips") == [
        ("Monday", 5, "a", 2), ("Monday", 5, "b", 1), ("Monday", 6, "a", 1)
    ]
    filled = rollup.five_grains(rollup.base_rollup(trips(spark)), zones, fill="Unknown",
                                skip_zone=True)
    assert "daily_by_zone" not in filled
    assert ("b", "Unknown", 1) in rows(filled["daily_by_borough"], "company", "borough", "trips")


def test_month_label_of_the_file_is_kept(spark):
    zones = spark.createDataFrame(ZONES, "location_id bigint, borough string, zone string")
    labelled = trips(spark).withColumn("pickup_month", F.lit("2023-12"))
    grains = rollup.five_grains(rollup.base_rollup(labelled), zones)
    assert {r.pickup_month for r in grains["daily_by_zone"].collect()} == {"2023-12"}


def test_sums_of_absent_measures_are_left_out(spark):
    out = rollup.count_trips(trips(spark), ["company"])
    assert set(out.columns) == {"company", "trips", "tips", "shared_requests"}


def daily(spark, data):
    return spark.createDataFrame(data, "pickup_date date, pickup_month string, trips bigint")


def test_rows_that_differ_in_the_label_are_added_up(spark):
    source = Source("bases", 30, daily(spark, [(D, "2018-10", 100), (D, "2011-10", 4)]))
    assert rows(unify.daily_by_company([source]), "trips", "pickup_month") == [(104, "2018-10")]


def test_month_label_compatibility(spark):
    source = Source("bases", 30, daily(spark, [(D, "2018-10", 100), (D, "2018-11", 1)]))
    merged = unify.merge_sources([source], ["pickup_date", "company"], "daily",
                                 tie_break="month_label")
    assert rows(merged, "trips") == [(1,)]


def test_published_days_with_two_labels(spark):
    """Days of the published shards whose rows carry a second month label: by default
    nothing is lost, the compatibility rule loses what the published totals lack."""
    days = [
        (dt.date(2018, 10, 15), "2018-10", 5000), (dt.date(2018, 10, 15), "2011-10", 4),
        (dt.date(2022, 10, 10), "2022-10", 432_792), (dt.date(2022, 10, 10), "2022-11", 1),
        (dt.date(2023, 3, 10), "2023-03", 473_319), (dt.date(2023, 3, 10), "2023-20", 1),
    ]
    source = [Source("shards", 40, daily(spark, days))]
    keys = ["pickup_date", "company"]
    summed = unify.annual_summary(unify.merge_sources(source, keys, "daily"))
    assert rows(summed, "year", "trips") == [(2018, 5004), (2022, 432_793), (2023, 473_320)]
    label = unify.merge_sources(source, keys, "daily", tie_break="month_label")
    assert rows(unify.annual_summary(label), "year", "trips") == [(2018, 5000), (2022, 1), (2023, 1)]


def area(spark, data):
    return spark.createDataFrame(data, "pickup_date date, borough string, trips bigint")


def test_null_and_unknown_areas_are_one_key(spark):
    low = Source("records", 20, area(spark, [(D, None, 5), (D, "Queens", 6)]))
    high = Source("bases", 30, area(spark, [(D, "Unknown", 50)]))
    by_key = unify.daily_by_borough([low, high])
    assert rows(by_key, "borough", "trips") == [("Queens", 6), ("Unknown", 50)]
    by_day = unify.daily_by_borough([low, high], dedup_level="day")
    assert rows(by_day, "borough", "trips") == [("Unknown", 50)]


def test_wider_sources_keep_their_columns(spark):
    wide = spark.createDataFrame(
        [(D, "x", 3, 1.5)], "pickup_date date, company string, trips bigint, tips double"
    )
    merged = unify.daily_by_company(
        [Source("bases", 30, daily(spark, [(dt.date(2018, 1, 1), "2018-01", 2)])),
         Source("high", 40, wide)], company="x",
    )
    assert rows(merged, "trips", "tips", "source") == [(2, None, "bases"), (3, 1.5, "high")]


entries = st.lists(
    st.tuples(st.integers(0, 4), st.sampled_from(["Queens", "Unknown", None]),
              st.sampled_from([10, 20, 30]), st.integers(0, 50)),
    min_size=1, max_size=25,
)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(entries)
def test_best_source_equals_a_loop(spark, data):
    sums = defaultdict(int)
    for day, place, priority, n in data:
        sums[(day, place or "Unknown", priority)] += n
    want = {}
    for (day, place, priority), n in sorted(sums.items()):
        want[(day, place)] = (priority, n)
    sources = [
        Source(f"s{p}", p, area(spark, part))
        for p in (10, 20, 30)
        if (part := [(D + dt.timedelta(day), place, n) for day, place, q, n in data if q == p])
    ]
    merged = unify.daily_by_borough(sources).collect()
    got = {((r.pickup_date - D).days, r.borough): (r.source_priority, r.trips) for r in merged}
    assert got == want and len(merged) == len(want)
