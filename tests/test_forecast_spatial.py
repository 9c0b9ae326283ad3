"""Forecasts against brute force, and spatial operators on literal rows."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbflow.operators import fitting, spatial
from kerbflow.operators import forecast as fc
from kerbflow.operators.market import competitor_rank, trips_per_vehicle

DAY = dt.timedelta(days=1)
START = dt.date(2023, 1, 1)


def weekly(spark, n=420, series="a", extra=()):
    rows = [(series, START + i * DAY, 100 + 10 * (i % 7)) for i in range(n)]
    return spark.createDataFrame([*rows, *extra], "s string, pickup_date date, trips bigint")


def test_rows_cover_training_and_horizon(spark):
    holed = weekly(spark).filter(F.col("pickup_date") != START + 100 * DAY)
    rows = fc.forecast_rows(holed, ["s"], 2, "2023-01-10")
    got = {r.pickup_date: r.trips for r in rows.collect()}
    last = START + 419 * DAY
    assert min(got) == dt.date(2023, 1, 10) and got[START + 100 * DAY] == 0
    assert got[last] is not None and got[last + DAY] is None
    # 24 February is the last day: two months from the 25th end on 24 April.
    assert last == dt.date(2024, 2, 24) and max(got) == dt.date(2024, 4, 24)
    assert rows.select("first_day", "last_day").distinct().count() == 1


def test_short_series_drop_out_one_by_one(spark):
    both = weekly(spark).unionByName(weekly(spark, 300, "b"))
    out = fc.forecast(both, ["s"], "Seasonal naive", start="2023-01-01")
    assert {r.s for r in out.select("s").distinct().collect()} == {"a"}


def test_horizon_is_clamped(spark):
    rows = fc.forecast_rows(weekly(spark), ["s"], 99, "2023-01-01").filter("trips IS NULL")
    assert rows.count() == (dt.date(2025, 2, 24) - dt.date(2024, 2, 24)).days


def test_naive_repeats_the_last_week(spark):
    rows = fc.forecast_rows(weekly(spark), ["s"], 1, "2023-01-01")
    got = [r.trips_forecast for r in fc.seasonal_naive(rows, ["s"]).orderBy("pickup_date").collect()]
    want = list(np.resize([100 + 10 * (i % 7) for i in range(413, 420)], len(got)))
    assert got == want and len(got) == 29


def test_holt_winters_continues_a_weekly_pattern(spark):
    out = fc.forecast(weekly(spark), ["s"], "Holt-Winters", 1, start="2023-01-01")
    got = [r.trips_forecast for r in out.orderBy("pickup_date").collect()]
    want = [100 + 10 * (i % 7) for i in range(420, 420 + len(got))]
    assert got == pytest.approx(want, abs=1e-6)


def test_holt_winters_grid_is_the_best_of_single_fits():
    rng = np.random.default_rng(3)
    y = 50 + 0.1 * np.arange(120) + 8 * np.sin(np.arange(120) * 2 * np.pi / 7) + rng.normal(0, 2, 120)

    def single(a, b, g):
        first, second = y[:7].mean(), y[7:14].mean()
        level, trend, cycle = first, (second - first) / 7, list(y[:7] - first)
        error = 0.0
        for t, v in enumerate(y):
            guess = level + trend
            error += (v - guess - cycle[t % 7]) ** 2
            new = a * (v - cycle[t % 7]) + (1 - a) * guess
            trend = b * (new - level) + (1 - b) * trend
            cycle[t % 7] = g * (v - guess) + (1 - g) * cycle[t % 7]
            level = new
        ahead = [level + h * trend + cycle[(120 + h - 1) % 7] for h in range(1, 11)]
        return error, ahead

    best = min(
        (single(a, b, g) for a in fitting.LEVEL_GRID for b in fitting.TREND_GRID
         for g in fitting.SEASON_GRID), key=lambda r: r[0],
    )
    assert fitting.holt_winters_predict(y, 10) == pytest.approx(best[1])


def test_holt_winters_fold_equals_the_recursion(spark):
    """The fold over arrays against the vectorized recursion, short and null series too."""
    rng = np.random.default_rng(11)
    data, want = [], {}
    for name, n in (("a", 90), ("b", 14), ("c", 13), ("d", 3), (None, 40)):
        y = rng.integers(0, 200, n)
        data += [(name, START + k * DAY, int(v)) for k, v in enumerate(y)]
        data += [(name, START + k * DAY, None) for k in range(n, n + 11)]
        values = (fitting.holt_winters_predict(y.astype(float), 11) if n >= 14
                  else fitting.naive_predict(y.astype(float), 11))
        want[name] = np.clip(values, 0, None)
    rows = spark.createDataFrame(data, "s string, pickup_date date, trips bigint").repartition(5)
    out = fc.smoothed_forecast(rows, ["s"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    got = {}
    for r in out.orderBy("pickup_date").collect():
        got.setdefault(r.s, []).append(r.trips_forecast)
        assert r.model == ("Seasonal naive" if r.s in ("c", "d") else "Holt-Winters")
    assert set(got) == set(want)
    for name, values in want.items():
        assert got[name] == pytest.approx(list(values), abs=1e-6)


def test_ridge_picks_the_least_leave_one_out_error():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 6))
    y = x @ rng.normal(size=6) + rng.normal(0, 2, 40) + 7

    def solve(xs, ys, a):
        mean = xs.mean(axis=0)
        z = xs - mean
        coef = np.linalg.solve(z.T @ z + a * np.eye(6), z.T @ (ys - ys.mean()))
        return coef, ys.mean() - mean @ coef

    errors = {}
    for a in fitting.PENALTIES:
        left_out = []
        for i in range(40):
            keep = np.arange(40) != i
            coef, intercept = solve(x[keep], y[keep], a)
            left_out.append((y[i] - x[i] @ coef - intercept) ** 2)
        errors[a] = np.mean(left_out)
    best = min(errors, key=errors.get)
    coef, intercept, chosen = fitting.ridge_fit(x, y)
    assert chosen == best
    want, want_intercept = solve(x, y, best)
    assert coef == pytest.approx(want) and intercept == pytest.approx(want_intercept)


def test_regression_learns_calendar_effects(spark):
    context = spark.createDataFrame([(START,)], "date date").select(
        F.explode(F.sequence(F.lit(START), F.lit(START + 700 * DAY))).alias("date")
    ).select(
        "date", (F.weekday("date") >= 5).alias("is_weekend"), F.lit(False).alias("has_precipitation"),
        F.lit(60.0).alias("temperature_avg_f"), F.lit(0.0).alias("precipitation_sum"),
    )
    out = fc.forecast(weekly(spark), ["s"], "Regression + seasonality", 1, context, "2023-01-01")
    rows = out.orderBy("pickup_date").collect()
    want = [100 + 10 * (i % 7) for i in range(420, 420 + len(rows))]
    assert {r.model for r in rows} == {"Regression + seasonality"}
    assert [r.trips_forecast for r in rows] == pytest.approx(want, abs=1.0)


def test_fallback_chain(spark):
    no_context = fc.forecast(weekly(spark), ["s"], "Regression + seasonality", start="2023-01-01")
    assert {r.model for r in no_context.collect()} == {"Regression + seasonality"}
    few = fc.forecast(weekly(spark, 10), ["s"], "Holt-Winters", start="2023-01-01", least=5)
    assert {r.model for r in few.collect()} == {"Seasonal naive"}


def test_forecast_is_never_negative(spark):
    falling = spark.createDataFrame(
        [("a", START + i * DAY, max(0, 400 - i)) for i in range(420)],
        "s string, pickup_date date, trips bigint",
    )
    out = fc.forecast(falling, ["s"], "Holt-Winters", 3, start="2023-01-01")
    assert out.agg(F.min("trips_forecast")).first()[0] == 0.0


def test_flat_rain_keeps_the_feature_at_zero(spark):
    context = spark.createDataFrame([(START, 3.0)], "date date, precipitation_sum double")
    rows = fc.forecast_rows(weekly(spark), ["s"], 1, "2023-01-01")
    wet = fc.regression_frame(rows, ["s"], context)
    flat = fc.regression_frame(rows, ["s"], context, flat_rain=True)
    assert wet.agg(F.max("precipitation_sum")).first()[0] == 3.0
    assert flat.agg(F.max("precipitation_sum")).first()[0] == 0.0


def ring(i, points, r=0):
    return [(i, r, k, float(x), float(y)) for k, (x, y) in enumerate(points)]


def test_centroids_of_square_l_shape_and_hole(spark):
    square = [(0, 0), (2, 0), (2, 2), (0, 2)]
    shape = [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]
    far = [(x + 980_000, y + 190_000) for x, y in square]
    outer, hole = [(0, 0), (4, 0), (4, 4), (0, 4)], [(2, 1), (2, 3), (3, 3), (3, 1)]
    data = ring(1, square) + ring(2, shape) + ring(3, far) + ring(4, outer) + ring(4, hole, 1)
    df = spark.createDataFrame(data, "location_id int, ring int, seq int, x double, y double")
    got = {r.location_id: (r.x, r.y, r.area) for r in spatial.ring_centroids(df).collect()}
    assert got[1] == pytest.approx((1, 1, 4)) and got[2] == pytest.approx((5 / 6, 5 / 6, 3))
    assert got[3] == pytest.approx((980_001, 190_001, 4))
    assert got[4] == pytest.approx(((4 * 4 * 2 - 2 * 2.5) / 14, 2, 14))


@pytest.mark.parametrize("portable", [False, True])
def test_sample_is_the_same_at_any_partitioning(spark, portable):
    points = spark.range(5000).select(F.col("id"), (F.col("id") * 2).alias("lat"))

    def sample(df, n, seed=42):
        return {r.id for r in spatial.point_sample(df, "id", n, seed, portable).collect()}

    a = sample(points.repartition(3), 700)
    assert a == sample(points.repartition(11), 700) and len(a) == 700
    assert sample(points, 700, seed=7) != a
    assert len(sample(points, 9999)) == 5000


def test_located_growth(spark):
    ranked = spark.createDataFrame(
        [("a", "Q", 10), ("b", "Q", -40), ("c", "Q", 5)], "zone string, borough string, trip_delta bigint"
    )
    spots = spark.createDataFrame(
        [("a", "Q", 1.0, 2.0), ("b", "Q", None, 2.0), ("c", "Q", 3.0, 4.0)],
        "zone string, borough string, latitude double, longitude double",
    )
    got = {r.zone: r.delta_share for r in spatial.locate_growth(ranked, spots).collect()}
    assert got == {"a": 0.25, "c": 0.125}


def test_market(spark):
    supply = spark.createDataFrame(
        [("a", 10, 2), ("a", 10, 3), ("b", 20, 0), ("c", 5, 1)], "base string, trips bigint, vehicles bigint"
    )
    got = {r.base: r.trips_per_vehicle for r in trips_per_vehicle(supply, ["base"]).collect()}
    assert got == {"a": 4.0, "b": None, "c": 5.0}
    ranks = {r.base: r["rank"] for r in competitor_rank(supply, "base").collect()}
    assert ranks == {"a": 1, "b": 1, "c": 3}
