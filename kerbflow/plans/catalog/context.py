"""Calendar, weather and context queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbflow.operators import context as ctx
from kerbflow.plans.catalog.registry import query
from kerbflow.plans.catalog.standins import (
    DEMAND,
    HOLIDAYS,
    SPINE,
    WEATHER,
    context,
    day_spine,
    holidays,
    named_demand,
    order_days,
    weather,
)

_CALENDAR = """date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
       monthname(date) AS month_name, dayname(date) AS weekday,
       CAST(isodow(date) - 1 AS INTEGER) AS weekday_num,
       CAST(date_trunc('week', date) AS DATE) AS week_start, isodow(date) >= 6 AS is_weekend,
       day(date) = 1 AS is_month_start, date = last_day(date) AS is_month_end, holiday_name,
       holiday_name IS NOT NULL AS is_federal_holiday, CAST(NULL AS VARCHAR) AS nyc_event,
       FALSE AS has_nyc_event"""


@query("federal_holidays", f"""WITH {SPINE}, {HOLIDAYS}
SELECT date, holiday_name FROM holidays""")
def federal_holidays(spark, folder):
    return holidays(spark, folder)


@query("calendar_features", f"""WITH {SPINE}, {HOLIDAYS}
SELECT {_CALENDAR} FROM spine LEFT JOIN holidays USING (date)""")
def calendar_features(spark, folder):
    return ctx.calendar_features(day_spine(spark, folder), holidays(spark, folder))


@query("daily_context", f"""WITH {SPINE}, {HOLIDAYS}, {WEATHER}
SELECT {_CALENDAR}, round(temperature_avg_f, 6) AS temperature_avg_f,
       round(precipitation_sum, 6) AS precipitation_sum, has_rain, has_snow, has_precipitation
FROM spine LEFT JOIN holidays USING (date) LEFT JOIN weather USING (date)""")
def daily_context(spark, folder):
    raw = ["weather_code", "temperature_2m_max", "temperature_2m_min", "rain_sum", "snowfall_sum"]
    out = context(spark, folder).drop(*raw)
    return out.withColumns({c: F.round(c, 6) for c in ("temperature_avg_f", "precipitation_sum")})


@query("enriched_rollup", f"""WITH {DEMAND}, {SPINE}, {HOLIDAYS}, {WEATHER}, d AS (
  SELECT pickup_date, borough, CAST(SUM(trips) AS BIGINT) AS trips FROM demand GROUP BY 1, 2)
SELECT pickup_date, borough, trips, dayname(pickup_date) AS weekday, holiday_name,
       has_precipitation, round(temperature_avg_f, 6) AS temperature_avg_f
FROM d LEFT JOIN holidays h ON h.date = pickup_date LEFT JOIN weather w ON w.date = pickup_date""")
def enriched_rollup(spark, folder):
    rollup = named_demand(spark, folder).groupBy("pickup_date", "borough").agg(
        F.sum("trips").alias("trips")
    )
    return ctx.enrich(rollup, context(spark, folder)).select(
        "pickup_date", "borough", "trips", "weekday", "holiday_name", "has_precipitation",
        F.round("temperature_avg_f", 6).alias("temperature_avg_f"),
    )


_JOINED = f"""WITH {SPINE}, {WEATHER}, d AS (
  SELECT pickup_date, trips, has_precipitation, temperature_avg_f
  FROM daily LEFT JOIN weather ON date = pickup_date)"""


def _daily_weather(spark, folder):
    return ctx.daily_with_context(order_days(spark, folder), weather(spark, folder))


@query("weather_lift", f"""{_JOINED}
SELECT round(AVG(trips) FILTER (WHERE has_precipitation)
       / AVG(trips) FILTER (WHERE NOT has_precipitation) - 1, 6) AS weather_lift FROM d""")
def weather_lift(spark, folder):
    out = ctx.weather_lift(_daily_weather(spark, folder))
    return out.withColumn("weather_lift", F.round("weather_lift", 6))


@query("weather_means", f"""{_JOINED}
SELECT CASE WHEN has_precipitation THEN 'Rain/Snow' ELSE 'Dry' END AS weather,
       round(AVG(trips), 6) AS avg_trips
FROM d WHERE has_precipitation IS NOT NULL GROUP BY 1""")
def weather_means(spark, folder):
    out = ctx.weather_means(_daily_weather(spark, folder))
    return out.withColumn("avg_trips", F.round("avg_trips", 6))


@query("temp_trendline", f"""{_JOINED}
SELECT has_precipitation, round(regr_slope(trips, temperature_avg_f), 6) AS slope,
       round(regr_intercept(trips, temperature_avg_f), 6) AS intercept,
       round(regr_r2(trips, temperature_avg_f), 6) AS r2, COUNT(*) AS days
FROM d WHERE has_precipitation IS NOT NULL GROUP BY 1""")
def temp_trendline(spark, folder):
    out = ctx.temperature_trend(_daily_weather(spark, folder))
    return out.withColumns({c: F.round(c, 6) for c in ("slope", "intercept", "r2")})


@query("impute_climatology", f"""WITH {SPINE}, {WEATHER}, d AS (
  SELECT spine.date, has_precipitation,
         CASE WHEN year(spine.date) % 2 = 0 THEN temperature_avg_f END AS t, precipitation_sum AS p
  FROM spine LEFT JOIN weather USING (date)),
m AS (SELECT *, AVG(t) OVER (PARTITION BY dayofyear(date)) AS td,
             AVG(t) OVER (PARTITION BY month(date)) AS tm, AVG(t) OVER () AS ta,
             AVG(p) OVER (PARTITION BY dayofyear(date)) AS pd,
             AVG(p) OVER (PARTITION BY month(date)) AS pm, AVG(p) OVER () AS pa FROM d)
SELECT date AS pickup_date, coalesce(has_precipitation, FALSE) AS has_precipitation,
       round(coalesce(t, td, tm, ta, 0), 6) AS temperature_avg_f,
       round(coalesce(p, pd, pm, pa, 0), 6) AS precipitation_sum FROM m""")
def impute_climatology(spark, folder):
    """Odd years have no temperature, the first week of a month no reading at all."""
    days = day_spine(spark, folder).join(weather(spark, folder), "date", "left").select(
        F.col("date").alias("pickup_date"),
        "has_precipitation",
        F.when(F.year("date") % 2 == 0, F.col("temperature_avg_f")).alias("temperature_avg_f"),
        "precipitation_sum",
    )
    values = ["temperature_avg_f", "precipitation_sum"]
    out = ctx.impute_climatology(days, values, ["has_precipitation"])
    return out.withColumns({v: F.round(v, 6) for v in values})
