"""The test tables read as trips, zones, demand, weather and events.

Each stand-in has a SQL twin (upper case) for the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbflow.functions.timeparts import month_label
from kerbflow.operators.context import (
    calendar_features,
    daily_context,
    federal_holidays,
    weather_features,
)
from kerbflow.operators.series import date_spine

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table with its declared schema (no footer is read to infer one)."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


# -- trips -----------------------------------------------------------------------------

def event_trips(spark: SparkSession, folder: str) -> DataFrame:
    """events as trips; 27 locations, two of which the zone dimension lacks."""
    return table(spark, folder, "events").select(
        "event_id",
        F.col("ts").alias("pickup_datetime"),
        F.col("event_type").alias("company"),
        (F.col("user_id") % 27).alias("location_id"),
        "value",
    )


TRIPS = """trips AS (
  SELECT event_id, ts AS pickup_datetime, event_type AS company,
         user_id % 27 AS location_id, value, CAST(ts AS DATE) AS pickup_date,
         strftime(ts, '%Y-%m') AS pickup_month, CAST(hour(ts) AS INTEGER) AS hour,
         CAST(isodow(ts) - 1 AS INTEGER) AS weekday_num, dayname(ts) AS weekday
  FROM events)"""


def zones(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(
        F.col("n_nationkey").cast("bigint").alias("location_id"),
        F.col("r_name").alias("borough"),
        F.col("n_name").alias("zone"),
    )


ZONES = """zones AS (
  SELECT CAST(n_nationkey AS BIGINT) AS location_id, r_name AS borough, n_name AS zone
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey)"""


# -- demand ----------------------------------------------------------------------------

def order_days(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per day."""
    day = F.to_date("o_orderdate").alias("pickup_date")
    return table(spark, folder, "orders").groupBy(day).agg(F.count(F.lit(1)).alias("trips"))


DAILY = """daily AS (
  SELECT CAST(o_orderdate AS DATE) AS pickup_date, COUNT(*) AS trips FROM orders GROUP BY 1)"""


def demand(spark: SparkSession, folder: str, where: Column | None = None) -> DataFrame:
    """Orders per (day, segment, nation).

    Orders are counted per (customer, day) before the join: a customer with a large
    part of all orders then brings at most one row per day to its join partition.
    """
    orders = table(spark, folder, "orders")
    chosen = orders if where is None else orders.filter(where)
    per_customer = chosen.groupBy(
        "o_custkey", F.to_date("o_orderdate").alias("pickup_date")
    ).agg(F.count(F.lit(1)).alias("n"))
    customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return (
        per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .groupBy(
            "pickup_date",
            F.col("c_mktsegment").alias("company"),
            F.col("c_nationkey").cast("bigint").alias("location_id"),
        )
        .agg(F.sum("n").alias("trips"))
    )


def named_demand(spark: SparkSession, folder: str, where: Column | None = None) -> DataFrame:
    """Demand with zone and borough names, joined after the counting."""
    return demand(spark, folder, where).join(zones(spark, folder), "location_id", "left")


DEMAND = f"""{ZONES}, demand AS (
  SELECT CAST(o_orderdate AS DATE) AS pickup_date, c_mktsegment AS company,
         z.location_id, z.borough, z.zone, COUNT(*) AS trips
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
              LEFT JOIN zones z ON c_nationkey = z.location_id
  GROUP BY ALL)"""


def month_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per month label, and whether they reach the mean of all months."""
    days = order_days(spark, folder)
    months = days.groupBy(month_label(F.col("pickup_date")).alias("month")).agg(
        F.sum("trips").alias("n")
    )
    return months.withColumn("busy", F.col("n") >= months.agg(F.avg("n")).scalar())


MONTHS = """months AS (
  SELECT month, n, n >= AVG(n) OVER () AS busy FROM (
    SELECT strftime(o_orderdate, '%Y-%m') AS month, COUNT(*) AS n FROM orders GROUP BY 1))"""


# -- calendar and weather ----------------------------------------------------------------

def order_range(spark: SparkSession, folder: str) -> DataFrame:
    """One row (lo, hi): first and last order day."""
    day = F.to_date("o_orderdate")
    return table(spark, folder, "orders").agg(F.min(day).alias("lo"), F.max(day).alias("hi"))


def day_spine(spark: SparkSession, folder: str) -> DataFrame:
    return date_spine(order_range(spark, folder)).withColumnRenamed("pickup_date", "date")


SPINE = f"""{DAILY}, spine AS (
  SELECT CAST(unnest(generate_series((SELECT MIN(pickup_date) FROM daily),
         (SELECT MAX(pickup_date) FROM daily), INTERVAL 1 DAY)) AS DATE) AS date)"""


def raw_weather(days: DataFrame) -> DataFrame:
    """Readings as arithmetic of the date; no reading in the first week of a month."""
    doy, month = F.dayofyear("date"), F.month("date")
    rain = F.when(doy % 3 == 0, (doy % 10 + 1) / F.lit(10.0)).otherwise(0.0)
    snow = F.when(month.isin(12, 1, 2) & (doy % 9 == 0), 0.5).otherwise(0.0)
    top = 85 - F.abs(doy - 200) / F.lit(4.0)
    return days.filter(F.dayofmonth("date") > 7).select(
        "date",
        (doy % 5).alias("weather_code"),
        top.alias("temperature_2m_max"),
        (top - 15).alias("temperature_2m_min"),
        (rain + snow).alias("precipitation_sum"),
        rain.alias("rain_sum"),
        snow.alias("snowfall_sum"),
    )


WEATHER = """raw_weather AS (
  SELECT date, 85 - abs(dayofyear(date) - 200) / 4.0::DOUBLE AS top,
         CASE WHEN dayofyear(date) % 3 = 0 THEN (dayofyear(date) % 10 + 1) / 10.0::DOUBLE
              ELSE 0.0::DOUBLE END AS rain,
         CASE WHEN month(date) IN (12, 1, 2) AND dayofyear(date) % 9 = 0 THEN 0.5::DOUBLE
              ELSE 0.0::DOUBLE END AS snow
  FROM spine WHERE day(date) > 7),
weather AS (
  SELECT date, (top + top - 15) / 2 AS temperature_avg_f, rain + snow AS precipitation_sum,
         rain > 0 AS has_rain, snow > 0 AS has_snow, rain + snow > 0 AS has_precipitation
  FROM raw_weather)"""


def weather(spark: SparkSession, folder: str) -> DataFrame:
    return weather_features(raw_weather(day_spine(spark, folder)))


def holidays(spark: SparkSession, folder: str) -> DataFrame:
    return federal_holidays(order_range(spark, folder))


HOLIDAYS = """years AS (
  SELECT unnest(generate_series((SELECT year(MIN(date)) - 1 FROM spine),
                                (SELECT year(MAX(date)) + 1 FROM spine))) AS y),
fixed_days AS (
  SELECT name, make_date(y, m, d) AS day FROM years, (VALUES
    ('New Year''s Day', 1, 1), ('Independence Day', 7, 4), ('Veterans Day', 11, 11),
    ('Christmas Day', 12, 25), ('Juneteenth National Independence Day', 6, 19)) t(name, m, d)
  WHERE m <> 6 OR y >= 2021),
weekday_days AS (
  SELECT name, n, nth, day,
         ROW_NUMBER() OVER (PARTITION BY y, name ORDER BY day) AS up,
         ROW_NUMBER() OVER (PARTITION BY y, name ORDER BY day DESC) AS down
  FROM (SELECT y, name, n AS nth, dow AS n,
               CAST(unnest(generate_series(make_date(y, m, 1),
                    last_day(make_date(y, m, 1)), INTERVAL 1 DAY)) AS DATE) AS day, dow
        FROM years, (VALUES
          ('Birthday of Martin Luther King, Jr.', 1, 1, 3), ('Washington''s Birthday', 2, 1, 3),
          ('Memorial Day', 5, 1, -1), ('Labor Day', 9, 1, 1), ('Columbus Day', 10, 1, 2),
          ('Thanksgiving Day', 11, 4, 4)) t(name, m, dow, n)
        WHERE m <> 1 OR y >= 1986)
  WHERE isodow(day) = dow),
holidays AS (
  SELECT date, holiday_name FROM (
    SELECT CASE isodow(day) WHEN 6 THEN day - 1 WHEN 7 THEN day + 1 ELSE day END AS date,
           name AS holiday_name FROM fixed_days
    UNION ALL
    SELECT day, name FROM weekday_days WHERE up = nth OR (nth = -1 AND down = 1))
  WHERE date BETWEEN (SELECT MIN(date) FROM spine) AND (SELECT MAX(date) FROM spine))"""


def context(spark: SparkSession, folder: str) -> DataFrame:
    calendar = calendar_features(day_spine(spark, folder), holidays(spark, folder))
    return daily_context(calendar, weather(spark, folder))
