"""Context, event calendar and event impact on literal rows."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kerbflow.operators import context as ctx
from kerbflow.operators import events as ev

DAY = dt.timedelta(days=1)
EVENT = "date date, event_name string, event_category string, venue string, borough string"


def spine(spark, lo, hi):
    return spark.createDataFrame([(lo + i * DAY,) for i in range((hi - lo).days + 1)], "date date")


def test_calendar_and_context(spark):
    lo, hi = dt.date(2021, 12, 25), dt.date(2022, 1, 2)
    span = spark.createDataFrame([(lo, hi)], "lo date, hi date")
    cal = ctx.calendar_features(spine(spark, lo, hi), ctx.federal_holidays(span))
    weather = spark.createDataFrame(
        [(lo, 50.0, 40.0, 0.0, None, 0.2), (lo + DAY, 41.0, 30.0, 0.1, 0.0, 0.1)],
        "date date, temperature_2m_max double, temperature_2m_min double, rain_sum double, "
        "snowfall_sum double, precipitation_sum double",
    )
    rows = {r.date: r for r in
            ctx.daily_context(cal, ctx.weather_features(weather)).collect()}
    assert rows[dt.date(2021, 12, 31)].holiday_name == "New Year's Day"
    assert rows[dt.date(2021, 12, 31)].is_month_end and not rows[lo].is_month_start
    assert rows[lo].temperature_avg_f == 45.0
    assert (rows[lo].has_rain, rows[lo].has_snow, rows[lo].has_precipitation) == (False, False, True)
    assert rows[hi].temperature_avg_f is None and rows[hi].is_weekend
    assert rows[dt.date(2021, 12, 27)].week_start == dt.date(2021, 12, 27)


def test_weather_lift(spark):
    lo = dt.date(2024, 1, 1)

    def lift(data):
        df = spark.createDataFrame(
            [(lo + i * DAY, n, wet) for i, (n, wet) in enumerate(data)],
            "pickup_date date, trips bigint, has_precipitation boolean",
        )
        return ctx.weather_lift(df).first()[0]

    assert lift([(10, False), (20, False), (30, True), (99, None)]) == pytest.approx(1.0)
    assert lift([(10, False)]) is None and lift([(10, True)]) is None
    assert lift([(0, False), (10, True)]) is None


def test_imputation_order(spark):
    data = [(dt.date(2023, 1, 1), 10.0, True), (dt.date(2024, 1, 1), None, None),
            (dt.date(2024, 1, 5), None, None), (dt.date(2024, 1, 6), 20.0, False),
            (dt.date(2024, 6, 1), None, None)]
    df = spark.createDataFrame(data, "pickup_date date, t double, wet boolean")
    got = {r.pickup_date: (r.t, r.wet) for r in ctx.impute_climatology(df, ["t"], ["wet"]).collect()}
    assert got[dt.date(2024, 1, 1)] == (10.0, False)
    assert got[dt.date(2024, 1, 5)] == (15.0, False)
    assert got[dt.date(2024, 6, 1)] == (15.0, False)
    none = df.withColumn("t", F.lit(None).cast("double"))
    assert {r.t for r in ctx.impute_climatology(none, ["t"]).collect()} == {0.0}


def test_event_calendar_keeps_the_last_source(spark):
    d = dt.date(2024, 7, 4)
    context = spark.createDataFrame(
        [(d, "Independence Day", True, "Pride Parade"), (d + DAY, None, None, "Pride Parade")],
        "pickup_date date, holiday_name string, is_federal_holiday boolean, nyc_event string",
    )
    custom = spark.createDataFrame(
        [(d + DAY, " pride parade", "Parade", "Route", "Manhattan"),
         (d, "Independence Day", "Concert", None, "Queens")], EVENT,
    )
    got = {tuple(r) for r in ev.event_calendar(context, custom).collect()}
    assert got == {
        (d, "Independence Day", "Federal holiday", None, None),
        (d, "Independence Day", "Concerts & music festivals", None, "Queens"),
        (d + DAY, " pride parade", "Parades & civic festivals", "Route", "Manhattan"),
    }


def test_category_order(spark):
    d = dt.date(2024, 7, 4)
    events = spark.createDataFrame(
        [(d, "a", "Zoo", None, None), (d, "b", "Other event", None, None),
         (d, "c", "Sports", None, None), (d, "d", "Art", None, None)], EVENT,
    )
    got = [r.event_category for r in ev.ordered_categories(events).orderBy("position").collect()]
    assert got == ["Sports", "Other event", "Art", "Zoo"]


def test_scope(spark):
    d = dt.date(2024, 7, 4)
    events = spark.createDataFrame(
        [(d, "a", "Sports", None, "Queens"), (d, "b", "Sports", None, "Bronx"),
         (d, "c", "Sports", None, None), (d, "d", "Sports", None, ""),
         (d, "e", "Sports", None, "Multiple boroughs"), (d + DAY, "f", "Sports", None, "Queens")],
        EVENT,
    )
    kept = ev.events_in_scope(events, F.lit(d), F.lit(d), ["Sports"], ["Queens"])
    assert {r.event_name for r in kept.collect()} == {"a", "c", "d", "e"}


def loop_impact(by_area, events, exclusions, width):
    """The same measure, one event after the other."""
    total = {}
    for (day, _), n in by_area.items():
        total[day] = total.get(day, 0) + n
    known = {a for _, a in by_area if a in ("Queens", "Bronx")}
    out = {}
    for day, name, area in events:
        own = {d: n for (d, a), n in by_area.items() if a == area} if area in known else total
        if day not in own:
            continue
        base = [d for d in own if abs((d - day).days) <= width and d.weekday() == day.weekday()
                and d not in exclusions]
        mean = sum(own[d] for d in base) / len(base) if base else None
        lift = own[day] / mean - 1 if mean else None
        control = None
        if area in known and base:
            rest = sum(total[d] - own[d] for d in base) / len(base)
            control = (total[day] - own[day]) / rest - 1 if rest > 0 else None
        did = lift - control if lift is not None and control is not None else None
        out[(day, name)] = (own[day], lift, control, did, len(base))
    return out


START = dt.date(2024, 1, 1)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.dictionaries(
        st.tuples(st.integers(0, 60), st.sampled_from(["Queens", "Bronx", "EWR"])),
        st.integers(0, 9), min_size=1, max_size=80),
    st.lists(st.tuples(st.integers(0, 60), st.sampled_from(["Queens", "Bronx", "Nowhere", None])),
             min_size=1, max_size=12),
    st.sampled_from([14, 17, 42]),
)
def test_impact_equals_a_loop(spark, demand, happenings, width):
    by_area = {(START + d * DAY, a): n for (d, a), n in demand.items()}
    events = [(START + d * DAY, f"e{i}", a) for i, (d, a) in enumerate(happenings)]
    shown = events[: max(1, len(events) // 2)]
    area_df = spark.createDataFrame(
        [(d, a, n) for (d, a), n in by_area.items()], "pickup_date date, borough string, trips bigint"
    )

    def as_frame(rows):
        return spark.createDataFrame([(d, n, "Sports", None, a) for d, n, a in rows], EVENT)

    out = ev.event_impact(area_df, as_frame(shown), as_frame(events), width).collect()
    got = {(r.date, r.event_name): (r.trips, r.lift, r.control_lift, r.did_lift, r.baseline_days)
           for r in out}
    want = loop_impact(by_area, shown, {d for d, _, _ in events}, width)
    assert len(out) == len(want) and set(got) == set(want)
    for key, values in want.items():
        assert got[key] == tuple(pytest.approx(v) if isinstance(v, float) else v for v in values)


def test_no_matching_event_day_gives_an_empty_frame(spark):
    area = spark.createDataFrame([(START, "Queens", 1)], "pickup_date date, borough string, trips bigint")
    events = spark.createDataFrame([(START + DAY, "x", "Sports", None, None)], EVENT)
    out = ev.event_impact(area, events)
    assert out.count() == 0 and "did_lift" in out.columns


def test_summary_falls_back_to_raw(spark):
    schema = ("event_name string, event_category string, trips bigint, baseline_trips double, "
              "lift double, did_lift double")
    rows = [("a", "Sports", 10, 8.0, 0.25, -0.5), ("b", "Holiday", 4, 8.0, -0.5, None),
            ("c", "Holiday", 6, None, None, None)]
    got = {r.event_category: r for r in
           ev.event_summary(spark.createDataFrame(rows, schema)).collect()}
    assert (got["Sports"].plot_lift, got["Sports"].direction) == (-0.5, "Lower than baseline")
    assert (got["Holiday"].plot_lift, got["Holiday"].did_available) == (-0.5, False)
    assert got["Holiday"].events == 2 and got["Holiday"].avg_trips == 5.0
