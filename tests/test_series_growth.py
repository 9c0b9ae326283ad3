"""Series, comparison and growth on literal rows."""

from __future__ import annotations

import calendar
import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kerbflow.operators import filters, growth, series

DAY = dt.timedelta(days=1)
quick = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def frame(spark, data, extra=""):
    return spark.createDataFrame(data, f"pickup_date date, trips bigint{extra}")


days = st.dictionaries(st.integers(0, 40), st.integers(0, 9), min_size=1, max_size=20)


@quick
@given(days)
def test_fill_days_equals_a_loop(spark, data):
    start = dt.date(2024, 2, 20)
    df = frame(spark, [(start + k * DAY, v) for k, v in data.items()])
    got = {(r.pickup_date - start).days: r.trips for r in series.fill_days(df).collect()}
    assert got == {k: data.get(k, 0) for k in range(min(data), max(data) + 1)}
    missing = {(r.pickup_date - start).days for r in series.missing_dates(df).collect()}
    assert missing == set(range(min(data), max(data) + 1)) - set(data)


def shift_months(day, months):
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    return dt.date(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1]))


@quick
@given(
    st.dates(dt.date(2023, 12, 1), dt.date(2025, 3, 31)),
    st.sampled_from(["week", "month", "year"]),
    st.sampled_from(["previous", "last_year"]),
)
def test_compare_periods_equals_a_loop(spark, end, period, mode):
    data = {end - i * DAY: (i * 7) % 11 + 1 for i in range(0, 800) if i % 5 != 3 or i == 0}
    df = frame(spark, list(data.items()))
    start = {
        "week": end - end.weekday() * DAY, "month": end.replace(day=1),
        "year": end.replace(month=1, day=1),
    }[period]
    if mode == "last_year":
        other, other_end = shift_months(start, -12), shift_months(end, -12)
    else:
        other = {"week": start - 7 * DAY, "month": shift_months(start, -1),
                 "year": shift_months(start, -12)}[period]
        other_end = other + (end - start)
    want = set()
    for label, lo, hi in (("current", start, end), (mode, other, other_end)):
        for i in range((hi - lo).days + 1):
            plot = start + i * DAY
            want.add((label, i + 1, lo + i * DAY, plot if plot <= end else None,
                      data.get(lo + i * DAY, 0)))
    got = {tuple(r) for r in series.compare_periods(df, period, mode).collect()}
    assert got == want
    totals = series.comparison_totals(df, period, mode).first()
    now = sum(w[4] for w in want if w[0] == "current")
    before = sum(w[4] for w in want if w[0] == mode)
    assert (totals.current_total, totals.comparison_total) == (now, before)
    assert totals.delta == (pytest.approx(now / before - 1) if before else None)


def test_leap_day_leaves_the_axis(spark):
    df = frame(spark, [(dt.date(2025, 3, 1), 1), (dt.date(2024, 1, 1), 1)])
    rows = series.compare_periods(df, "year", "last_year").filter("period = 'last_year'").collect()
    assert len(rows) == 61 and [r.day for r in rows if r.plot_date is None] == [61]


def test_kpis_take_the_first_peak(spark):
    df = frame(spark, [(dt.date(2024, 1, 3), 5), (dt.date(2024, 1, 2), 5), (dt.date(2024, 1, 9), 2)])
    row = series.kpis(df).first()
    assert tuple(row) == (12, 4.0, dt.date(2024, 1, 2), 5)


def test_weekly_delta_counts_observed_days(spark):
    start = dt.date(2024, 1, 1)
    few = frame(spark, [(start + 2 * i * DAY, 1) for i in range(13)])
    assert series.weekly_delta(few).first()[0] is None
    many = frame(spark, [(start + 2 * i * DAY, 1 if i < 8 else 2) for i in range(15)])
    assert series.weekly_delta(many).first()[0] == pytest.approx(1.0)
    zero = frame(spark, [(start + i * DAY, 0 if i < 7 else 2) for i in range(14)])
    assert series.weekly_delta(zero).first()[0] is None


def test_growth_stats_without_history_is_null(spark):
    row = series.growth_stats(frame(spark, [(dt.date(2024, 1, 1), 3), (dt.date(2023, 12, 31), 2)]))
    got = row.first()
    assert got.dod == pytest.approx(0.5) and (got.wow, got.mom, got.yoy) == (None, None, None)


def test_rolling_is_by_row(spark):
    start = dt.date(2024, 1, 1)
    df = frame(spark, [(start + 10 * i * DAY, i) for i in range(9)])
    last = series.rolling_mean(df).orderBy(F.desc("pickup_date")).first()
    assert last.rolling_7d == pytest.approx(sum(range(2, 9)) / 7)


def test_resample_week_starts_on_monday(spark):
    df = frame(spark, [(dt.date(2024, 3, 3), 1), (dt.date(2024, 3, 4), 2)])
    got = {tuple(r) for r in series.resample(df, "week").collect()}
    assert got == {
        (dt.date(2024, 2, 26), 1, "Week of Feb 26, 2024"),
        (dt.date(2024, 3, 4), 2, "Week of Mar 04, 2024"),
    }


def test_presets_and_selection(spark):
    df = frame(spark, [(dt.date(2018, 1, 1), 1), (dt.date(2024, 5, 20), 2)])
    got = {r.preset: (r.start_date, r.end_date)
           for r in filters.preset_ranges(df, "2024-05-10").collect()}
    end = dt.date(2024, 5, 10)
    assert got["MTD"] == (dt.date(2024, 5, 1), end) and got["All"] == (dt.date(2018, 1, 1), end)
    assert got["5Y"] == (end - 1824 * DAY, end) and got["Post-2019"] == (dt.date(2019, 2, 1), end)
    late = df.filter("pickup_date > '2020-01-01'")
    assert "Post-2019" not in {r.preset for r in filters.preset_ranges(late, "2024-06-10").collect()}
    lo, hi = filters.preset_start(df, "7D", "2030-01-01")
    assert filters.in_period(df, lo, hi).count() == 1


def test_group_selection(spark):
    data = [(dt.date(2024, 1, 1), n, b) for n, b in
            [(5, "Queens"), (9, "Manhattan"), (1, "EWR"), (7, None)]]
    df = frame(spark, data, ", borough string")

    def names(**options):
        return {r.borough for r in filters.select_groups(df, "borough", **options).collect()}

    assert names(preset="all") == {"Queens", "Manhattan", "EWR"}
    assert names(preset="core") == {"Queens", "Manhattan"}
    assert names(preset="main") == {"Manhattan"} and names(preset="outer") == {"Queens"}
    assert names(preset="custom", custom=["EWR"]) == {"EWR"}
    assert names(preset="top3") == {"Queens", "Manhattan", "EWR"}


def growth_frame(spark):
    lo, hi = dt.date(2024, 2, 1), dt.date(2024, 3, 31)
    data = []
    for i in range((hi - lo).days + 1):
        day = lo + i * DAY
        now = day >= dt.date(2024, 3, 1)
        data += [(day, 10 if now else 5, "up"), (day, 2 if now else 8, "down")]
        if now:
            data += [(day, 1, "new"), (day, 3, None)]
        else:
            data.append((day, 4, "gone"))
    return frame(spark, data, ", zone string")


def test_growth_windows_and_null_groups(spark):
    out = growth.growth_opportunities(growth_frame(spark), ["zone"], 1, top=None,
                                      volume_quantile=None)
    got = {r.zone: r for r in out.collect()}
    assert set(got) == {"up", "down", "new", None}
    # 31 March less a month is 29 February, so the current window is March itself and
    # the prior one starts on 1 February.
    assert got["up"].current_trips == 310 and got["up"].prior_trips == 145
    assert got["new"].growth is None and got["new"].direction == "Positive"
    assert got[None].current_trips == 93


def test_growth_ranking(spark):
    df = growth_frame(spark)

    def order(**options):
        return [r.zone for r in growth.growth_opportunities(df, ["zone"], 1, **options).collect()]

    assert order(volume_quantile=None) == ["up", None, "new", "down"]
    assert order(volume_quantile=None, rank_by="largest_losses")[0] == "down"
    assert order(volume_quantile=None, rank_by="growth") == ["up", "down"]
    assert order(volume_quantile=0.5) == ["up", None]
    assert order(volume_quantile=None, top=1) == ["up"]


def test_growth_falls_back_to_all_groups(spark):
    df = growth_frame(spark).filter("zone = 'new' OR zone IS NULL OR zone = 'gone'")
    out = growth.growth_opportunities(df, ["zone"], 1, rank_by="growth", volume_quantile=0.9)
    assert {r.zone for r in out.collect()} == {"new", None}


def test_coverage_guard(spark):
    df = growth_frame(spark)
    full = growth.growth_opportunities(df, ["zone"], 1, complete_days=True, volume_quantile=None)
    assert full.count() == 4
    holed = df.filter("pickup_date <> '2024-02-10'")
    empty = growth.growth_opportunities(holed, ["zone"], 1, complete_days=True)
    assert empty.count() == 0 and "direction" in empty.columns
    meta = growth.growth_meta(holed, ["zone"], 1).first()
    assert meta.missing_days == 1 and meta.starts_late is False
    assert meta.current_window == "Mar 01, 2024 - Mar 31, 2024"
    assert growth.growth_meta(holed, ["zone"], 6).first().starts_late is True
