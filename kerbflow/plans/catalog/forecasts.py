"""Forecast queries: one series per region, trained from 1996."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbflow.operators import fitting
from kerbflow.operators import forecast as fc
from kerbflow.plans.catalog.registry import query
from kerbflow.plans.catalog.standins import (
    DEMAND,
    HOLIDAYS,
    SPINE,
    WEATHER,
    context,
    named_demand,
)

START = "1996-01-01"
BY = ["borough"]

_TRAIN = f"""WITH {DEMAND}, d AS (
  SELECT borough, pickup_date, CAST(SUM(trips) AS BIGINT) AS trips FROM demand
  WHERE borough IS NOT NULL GROUP BY 1, 2),
s AS (SELECT borough, MAX(pickup_date) AS hi,
             CAST(unnest(generate_series(MIN(pickup_date), MAX(pickup_date), INTERVAL 1 DAY))
                  AS DATE) AS pickup_date FROM d GROUP BY 1),
train AS (SELECT borough, hi, pickup_date, coalesce(trips, 0) AS trips
          FROM s LEFT JOIN d USING (borough, pickup_date)
          WHERE pickup_date >= DATE '{START}'
          QUALIFY COUNT(*) OVER (PARTITION BY borough) >= 365),
ends AS (SELECT DISTINCT borough, hi FROM train),
ahead AS (SELECT borough, hi, CAST(unnest(generate_series(hi + 1,
            CAST(hi + 1 + INTERVAL {{months}} MONTH AS DATE) - 1, INTERVAL 1 DAY)) AS DATE)
            AS pickup_date FROM ends)"""


@query("forecast_naive", f"""{_TRAIN.format(months=3)}
SELECT borough, a.pickup_date, CAST(t.trips AS DOUBLE) AS trips_forecast
FROM ahead a JOIN train t USING (borough)
WHERE t.pickup_date = a.hi - 6 + CAST((a.pickup_date - a.hi - 1) % 7 AS INTEGER)""")
def forecast_naive(spark, folder):
    return fc.seasonal_naive(fc.forecast_rows(named_demand(spark, folder), BY, 3, START), BY)


_DUMMIES = ", ".join(
    [f"(isodow(pickup_date) - 1 = {d})::INT::DOUBLE AS dow_{d}" for d in range(7)]
    + [f"(month(pickup_date) = {m})::INT::DOUBLE AS month_{m}" for m in range(1, 13)]
)


@query("forecast_features", f"""{_TRAIN.format(months=1)}, {SPINE}, {HOLIDAYS}, {WEATHER},
allrows AS (SELECT borough, pickup_date, trips FROM train
            UNION ALL SELECT borough, pickup_date, NULL FROM ahead),
starts AS (SELECT borough, MIN(pickup_date) AS lo FROM train GROUP BY 1),
ctx AS (
  SELECT pickup_date, isodow(pickup_date) >= 6 AND c.date IS NOT NULL AS is_weekend,
         day(pickup_date) = 1 AND c.date IS NOT NULL AS is_month_start,
         pickup_date = last_day(pickup_date) AND c.date IS NOT NULL AS is_month_end,
         h.date IS NOT NULL AS is_federal_holiday, coalesce(has_precipitation, FALSE) AS wet,
         temperature_avg_f AS t, precipitation_sum AS p
  FROM (SELECT DISTINCT pickup_date FROM allrows) a LEFT JOIN spine c ON c.date = pickup_date
       LEFT JOIN holidays h ON h.date = pickup_date LEFT JOIN weather w ON w.date = pickup_date),
filled AS (
  SELECT *, coalesce(t, AVG(t) OVER (PARTITION BY dayofyear(pickup_date)),
                     AVG(t) OVER (PARTITION BY month(pickup_date)), AVG(t) OVER (), 0) AS tf,
            coalesce(p, AVG(p) OVER (PARTITION BY dayofyear(pickup_date)),
                     AVG(p) OVER (PARTITION BY month(pickup_date)), AVG(p) OVER (), 0) AS pf
  FROM ctx),
r AS (SELECT *, CAST(pickup_date - lo AS DOUBLE) AS trend
      FROM allrows JOIN starts USING (borough) JOIN filled USING (pickup_date))
SELECT borough, pickup_date, trips, trend, trend * trend AS trend_sq,
       is_weekend::INT::DOUBLE AS is_weekend, is_month_start::INT::DOUBLE AS is_month_start,
       is_month_end::INT::DOUBLE AS is_month_end,
       is_federal_holiday::INT::DOUBLE AS is_federal_holiday, 0::DOUBLE AS has_nyc_event,
       wet::INT::DOUBLE AS has_precipitation, round(tf, 6) AS temperature_avg_f,
       round(pf, 6) AS precipitation_sum,
       round(sin(trend * (2 * pi() / 7)), 6) AS sin_weekly,
       round(cos(trend * (2 * pi() / 7)), 6) AS cos_weekly,
       round(sin(trend * (2 * pi() / 365.25)), 6) AS sin_annual,
       round(cos(trend * (2 * pi() / 365.25)), 6) AS cos_annual, {_DUMMIES} FROM r""")
def forecast_features(spark, folder):
    rows = fc.forecast_rows(named_demand(spark, folder), BY, 1, START)
    out = fc.regression_frame(rows, BY, context(spark, folder))
    rounded = [*fc.WEATHER, *(c for c in fc.FEATURES if c.startswith(("sin_", "cos_")))]
    return out.withColumns({c: F.round(c, 6) for c in rounded})


def _grid_sql(values):
    listed = ", ".join(f"{v}::DOUBLE" for v in values)
    return f"(SELECT unnest([{listed}]) AS v, unnest(range({len(values)})) AS i)"


_CYCLE = [f"c{k}" for k in range(7)]
#: The same recursion over the same grid; the season's current value is always ``c0``.
_HOLT_WINTERS = f"""{_TRAIN.format(months=1).replace("WITH ", "WITH RECURSIVE ", 1)},
seq AS (SELECT borough, CAST(trips AS DOUBLE) AS y,
               row_number() OVER (PARTITION BY borough ORDER BY pickup_date) - 1 AS i FROM train),
size AS (SELECT borough, COUNT(*) AS n FROM seq GROUP BY 1),
grid AS (SELECT a.v AS a, b.v AS b, g.v AS g, (a.i * 100 + b.i) * 100 + g.i AS k
         FROM {_grid_sql(fitting.LEVEL_GRID)} a, {_grid_sql(fitting.TREND_GRID)} b,
              {_grid_sql(fitting.SEASON_GRID)} g),
begin_ AS (SELECT borough, AVG(y) FILTER (i < 7) AS first, AVG(y) FILTER (i BETWEEN 7 AND 13) AS second,
                  {", ".join(f"MAX(y) FILTER (i = {k}) AS y{k}" for k in range(7))}
           FROM seq GROUP BY 1),
hw AS (
  SELECT borough, k, a, b, g, 0::BIGINT AS t, first AS level, (second - first) / 7 AS trend,
         {", ".join(f"y{k} - first AS c{k}" for k in range(7))}, 0::DOUBLE AS err
  FROM begin_, grid
  UNION ALL
  SELECT borough, k, a, b, g, t + 1, up, b * (up - level) + (1 - b) * trend,
         {", ".join(_CYCLE[1:])}, g * (y - guess) + (1 - g) * c0, err + (y - guess - c0) * (y - guess - c0)
  FROM (SELECT hw.*, y, level + trend AS guess, a * (y - c0) + (1 - a) * (level + trend) AS up
        FROM hw JOIN seq ON seq.borough = hw.borough AND seq.i = hw.t)),
best AS (SELECT hw.* FROM hw JOIN size ON size.borough = hw.borough AND hw.t = size.n
         QUALIFY row_number() OVER (PARTITION BY hw.borough ORDER BY err, k) = 1)
SELECT borough, ahead.pickup_date, 'Holt-Winters' AS model,
       round(greatest(0, level + (ahead.pickup_date - hi) * trend
             + ([{", ".join(_CYCLE)}])[CAST((ahead.pickup_date - hi - 1) % 7 + 1 AS INTEGER)]), 6)
         AS trips_forecast
FROM ahead JOIN best USING (borough)"""


def _rounded(out):
    return out.withColumn("trips_forecast", F.round("trips_forecast", 6))


@query("forecast_holt_winters", _HOLT_WINTERS)
def forecast_holt_winters(spark, folder):
    return _rounded(fc.forecast(named_demand(spark, folder), BY, "Holt-Winters", 1, start=START))


@query("forecast_ridge")
def forecast_ridge(spark, folder):
    return fc.forecast(named_demand(spark, folder), BY, "Regression + seasonality", 2,
                       context(spark, folder), start=START)


@query("forecast_ridge_no_context", f"""{_TRAIN.format(months=1)}
SELECT borough, a.pickup_date, 'Regression + seasonality' AS model FROM ahead a""")
def forecast_ridge_no_context(spark, folder):
    """Without a context the regression runs on calendar features, weather at 0."""
    out = fc.forecast(named_demand(spark, folder), BY, "Regression + seasonality", 1, start=START)
    return out.filter("trips_forecast >= 0").select("borough", "pickup_date", "model")


@query("forecast_ridge_optimal", f"""{_TRAIN.format(months=1)}
SELECT borough, TRUE AS optimal, TRUE AS least_error FROM ends""")
def forecast_ridge_optimal(spark, folder):
    """Normal equations and choice of penalty of each series, from Spark's own sums.

    At the optimum the gradient (sums of feature times residual, less penalty times
    coefficient) vanishes, and no other penalty has a smaller leave-one-out error.
    """
    rows = fc.forecast_rows(named_demand(spark, folder), BY, 1, START)
    return fc.ridge_optimality(rows, BY, context(spark, folder))


@query("forecast_selected", _HOLT_WINTERS)
def forecast_selected(spark, folder):
    """An unknown model falls back to Holt-Winters."""
    return _rounded(fc.forecast(named_demand(spark, folder), BY, "SARIMA", 1, start=START))
