"""Rollup queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from kerbflow.functions.timeparts import month_label
from kerbflow.operators import rollup, sets
from kerbflow.operators.market import competitor_rank, trips_per_vehicle
from kerbflow.operators.unify import union_sources
from kerbflow.plans.catalog.registry import query
from kerbflow.plans.catalog.standins import (
    DEMAND,
    TRIPS,
    ZONES,
    event_trips,
    named_demand,
    table,
    zones,
)
from kerbflow.session import shared_folder
from kerbflow.sources.sinks import write_parquet


def _base(spark, folder):
    return rollup.base_rollup(event_trips(spark, folder).drop("event_id", "value"))


def _grains(spark, folder, fill=None, skip_zone=False):
    return rollup.five_grains(_base(spark, folder), zones(spark, folder), fill=fill,
                              skip_zone=skip_zone)


def _one(spark, folder, grain, fill=None):
    trips = event_trips(spark, folder).drop("event_id", "value")
    return rollup.one_grain(trips, grain, zones(spark, folder), fill=fill)


@query("rollup_daily_company", f"""WITH {TRIPS}
SELECT pickup_date, pickup_month, company, COUNT(*) AS trips FROM trips GROUP BY ALL""")
def rollup_daily_company(spark, folder):
    return _one(spark, folder, "daily_by_company")


@query("rollup_daily_area", f"""WITH {TRIPS}, {ZONES}
SELECT pickup_date, pickup_month, borough, company, COUNT(*) AS trips
FROM trips LEFT JOIN zones USING (location_id) GROUP BY ALL""")
def rollup_daily_area(spark, folder):
    """Unmatched zones form a null borough."""
    return _one(spark, folder, "daily_by_borough")


@query("rollup_daily_zone", f"""WITH {TRIPS}, {ZONES}
SELECT pickup_date, pickup_month, location_id, coalesce(borough, 'Unknown') AS borough,
       coalesce(zone, 'Unknown') AS zone, company, COUNT(*) AS trips
FROM trips LEFT JOIN zones USING (location_id) GROUP BY ALL""")
def rollup_daily_zone(spark, folder):
    """Unmatched zones are named 'Unknown'."""
    return _one(spark, folder, "daily_by_zone", "Unknown")


@query("rollup_hourly", f"""WITH {TRIPS}
SELECT pickup_date, pickup_month, hour, company, COUNT(*) AS trips FROM trips GROUP BY ALL""")
def rollup_hourly(spark, folder):
    return _one(spark, folder, "hourly_by_company")


@query("rollup_weekday_hour", f"""WITH {TRIPS}
SELECT weekday_num, weekday, hour, company, COUNT(*) AS trips FROM trips GROUP BY ALL""")
def rollup_weekday_hour(spark, folder):
    return _one(spark, folder, "weekday_hour_by_company")


@query("rollup_skip_zone", f"""WITH {TRIPS}, {ZONES}, named AS (
  SELECT trips.*, borough FROM trips LEFT JOIN zones USING (location_id))
SELECT grain, COUNT(*) AS groups, CAST(SUM(trips) AS BIGINT) AS trips FROM (
  SELECT 'daily_by_company' AS grain, COUNT(*) AS trips FROM named GROUP BY pickup_date, company
  UNION ALL
  SELECT 'daily_by_borough', COUNT(*) FROM named GROUP BY pickup_date, company, borough
  UNION ALL
  SELECT 'hourly_by_company', COUNT(*) FROM named GROUP BY pickup_date, company, hour
  UNION ALL
  SELECT 'weekday_hour_by_company', COUNT(*) FROM named GROUP BY weekday_num, company, hour)
GROUP BY 1""")
def rollup_skip_zone(spark, folder):
    """Groups and trips of every grain when the zone grain is left out."""
    parts = [
        df.agg(
            F.lit(name).alias("grain"),
            F.count(F.lit(1)).alias("groups"),
            F.sum("trips").alias("trips"),
        )
        for name, df in _grains(spark, folder, skip_zone=True).items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("rollup_zone_backfill", f"""WITH {TRIPS}, {ZONES}
SELECT pickup_date, pickup_month, company, location_id, borough, zone, COUNT(*) AS trips
FROM (SELECT * REPLACE (CASE WHEN company = 'error' THEN NULL ELSE location_id END
                        AS location_id) FROM trips) t LEFT JOIN zones USING (location_id)
WHERE location_id IS NOT NULL GROUP BY ALL""")
def rollup_zone_backfill(spark, folder):
    """Counting by location first, names after; trips without a location drop out."""
    trips = event_trips(spark, folder).withColumn(
        "location_id", F.when(F.col("company") != "error", F.col("location_id"))
    )
    return rollup.zone_backfill(trips, zones(spark, folder), ["company"])


@query("rollup_measures", """
SELECT CAST(l_shipdate AS DATE) AS pickup_date, l_linestatus AS company, COUNT(*) AS trips,
       round(SUM(l_quantity), 2) AS trip_miles, round(SUM(l_extendedprice), 2) AS passenger_fare,
       round(coalesce(SUM(CASE WHEN l_returnflag = 'A' THEN l_tax END), 0), 2) AS tips,
       CAST(coalesce(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 0) AS BIGINT)
         AS shared_requests
FROM lineitem GROUP BY ALL""")
def rollup_measures(spark, folder):
    """Counts, measure sums (all-null sums are 0) and flag counts in one pass."""
    trips = table(spark, folder, "lineitem").select(
        F.to_date("l_shipdate").alias("pickup_date"),
        F.col("l_linestatus").alias("company"),
        F.col("l_quantity").alias("trip_miles"),
        F.col("l_extendedprice").alias("base_passenger_fare"),
        F.when(F.col("l_returnflag") == "A", F.col("l_tax")).alias("tips"),
        (F.col("l_returnflag") == "R").alias("shared_request_flag"),
    )
    sums = rollup.count_trips(trips, ["pickup_date", "company"])
    return sums.withColumns(
        {c: F.round(c, 2) for c in ("trip_miles", "passenger_fare", "tips")}
    )


@query("rollup_grouping_sets", f"""WITH {TRIPS}, {ZONES}, named AS (
  SELECT trips.*, coalesce(borough, 'Unknown') AS b, coalesce(zone, 'Unknown') AS z
  FROM trips LEFT JOIN zones USING (location_id))
SELECT pickup_date, hour, weekday_num, location_id, b AS borough, z AS zone, company,
       COUNT(*) AS trips,
       CASE WHEN grouping(location_id) = 0 THEN 'zone' WHEN grouping(b) = 0 THEN 'borough'
            WHEN grouping(weekday_num) = 0 THEN 'weekday_hour'
            WHEN grouping(hour) = 0 THEN 'hourly' ELSE 'daily' END AS grain
FROM named GROUP BY GROUPING SETS (
  (pickup_date, company), (pickup_date, b, company), (pickup_date, location_id, b, z, company),
  (pickup_date, hour, company), (weekday_num, hour, company))""")
def rollup_grouping_sets(spark, folder):
    return rollup.grouping_set_rollup(_base(spark, folder), zones(spark, folder), fill="Unknown")


@query("rollup_null_base", """
SELECT CAST(ts AS DATE) AS pickup_date, CASE WHEN event_type <> 'error' THEN upper(event_type) END
         AS dispatching_base, COUNT(*) AS trips
FROM events GROUP BY 1, 2""")
def rollup_null_base(spark, folder):
    """Trips without a base are a group of their own."""
    base = F.when(F.col("event_type") != "error", F.upper("event_type"))
    trips = table(spark, folder, "events").select(
        F.to_date("ts").alias("pickup_date"), base.alias("dispatching_base")
    )
    return rollup.count_trips(trips, ["pickup_date", "dispatching_base"])


@query("rollup_day_location", f"""WITH {TRIPS}
SELECT pickup_date, location_id, COUNT(*) AS trips FROM trips
WHERE pickup_datetime >= TIMESTAMP '2024-01-01' AND pickup_datetime < TIMESTAMP '2024-02-01'
  AND company IN ('click', 'view') GROUP BY 1, 2""")
def rollup_day_location(spark, folder):
    """One month (half-open range, pushed to the scan) by truncated day and location."""
    month = rollup.between_times(
        event_trips(spark, folder), "2024-01-01", "2024-02-01", ["click", "view"]
    )
    return rollup.by_day_and_place(month)


@query("area_from_zone", f"""WITH {DEMAND}
SELECT pickup_date, borough, CAST(SUM(trips) AS BIGINT) AS trips FROM demand GROUP BY 1, 2""")
def area_from_zone(spark, folder):
    return rollup.area_from_zone(named_demand(spark, folder), ["pickup_date", "borough"])


@query("daily_unknown_area", """
SELECT CAST(o_orderdate AS DATE) AS pickup_date, 'Unknown' AS borough, COUNT(*) AS trips
FROM orders GROUP BY 1""")
def daily_unknown_area(spark, folder):
    trips = table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("pickup_date"))
    return rollup.unknown_area(rollup.count_trips(trips, ["pickup_date"]))


@query("hourly_profile", f"""WITH {TRIPS}
SELECT hour, COUNT(*) AS trips FROM trips GROUP BY 1""")
def hourly_profile(spark, folder):
    return rollup.hourly_profile(_one(spark, folder, "hourly_by_company"))


@query("weekday_profile", """
SELECT CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday_num, dayname(o_orderdate) AS weekday,
       COUNT(*) AS trips FROM orders GROUP BY 1, 2""")
def weekday_profile(spark, folder):
    trips = table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("pickup_date"))
    return rollup.weekday_profile(rollup.count_trips(trips, ["pickup_date"]))


_CELLS = ",\n  ".join(
    f"CAST(COUNT(*) FILTER (WHERE hour = {h}) AS BIGINT) AS h{h:02d}" for h in range(24)
)


@query("heatmap", f"""WITH {TRIPS}
SELECT weekday_num, weekday, {_CELLS} FROM trips GROUP BY 1, 2""")
def heatmap(spark, folder):
    return rollup.heatmap(_one(spark, folder, "weekday_hour_by_company"))


def _supply(spark, folder):
    """Lines and distinct suppliers per ship date; vehicles are the suppliers."""
    pairs = table(spark, folder, "lineitem").groupBy(
        F.to_date("l_shipdate").alias("pickup_date"), "l_linestatus", "l_suppkey"
    ).agg(F.count(F.lit(1)).alias("trips"))
    return pairs.groupBy("pickup_date", F.col("l_linestatus").alias("base")).agg(
        F.sum("trips").alias("trips"), F.count(F.lit(1)).alias("vehicles")
    )


@query("trips_per_vehicle", """
SELECT CAST(l_shipdate AS DATE) AS pickup_date, l_linestatus AS base, COUNT(*) AS trips,
       COUNT(DISTINCT l_suppkey) AS vehicles,
       round(COUNT(*) / COUNT(DISTINCT l_suppkey), 6) AS trips_per_vehicle
FROM lineitem GROUP BY 1, 2""")
def supply_per_vehicle(spark, folder):
    out = trips_per_vehicle(_supply(spark, folder), ["pickup_date", "base"])
    return out.withColumn("trips_per_vehicle", F.round("trips_per_vehicle", 6))


@query("competitor_rank", """
SELECT base, trips, vehicles, RANK() OVER (ORDER BY trips DESC) AS rank FROM (
  SELECT l_suppkey AS base, COUNT(*) AS trips, COUNT(DISTINCT l_shipdate) AS vehicles
  FROM lineitem GROUP BY 1)""")
def rank_competitors(spark, folder):
    """Suppliers by lines; their ship days stand in for vehicles."""
    days = table(spark, folder, "lineitem").groupBy("l_suppkey", "l_shipdate").agg(
        F.count(F.lit(1)).alias("trips")
    )
    supply = days.groupBy(F.col("l_suppkey").alias("base")).agg(
        F.sum("trips").alias("trips"), F.count(F.lit(1)).alias("vehicles")
    )
    return competitor_rank(supply, "base")


@query("rollup_five_grains", f"""WITH {TRIPS}, {ZONES}, n AS (
  SELECT trips.*, borough, zone FROM trips LEFT JOIN zones USING (location_id))
SELECT 'daily_by_company' AS grain, pickup_date, NULL::INTEGER AS weekday_num,
       NULL::INTEGER AS hour, NULL::BIGINT AS location_id, NULL AS borough, company,
       COUNT(*) AS trips FROM n GROUP BY ALL
UNION ALL SELECT 'daily_by_borough', pickup_date, NULL, NULL, NULL, borough, company, COUNT(*)
FROM n GROUP BY ALL
UNION ALL SELECT 'daily_by_zone', pickup_date, NULL, NULL, location_id, borough, company, COUNT(*)
FROM n GROUP BY ALL
UNION ALL SELECT 'hourly_by_company', pickup_date, NULL, hour, NULL, NULL, company, COUNT(*)
FROM n GROUP BY ALL
UNION ALL SELECT 'weekday_hour_by_company', NULL, weekday_num, hour, NULL, NULL, company, COUNT(*)
FROM n GROUP BY ALL""")
def rollup_five_grains(spark, folder):
    """All five grains of one base rollup, stacked."""
    keys = ["pickup_date", "weekday_num", "hour", "location_id", "borough", "company", "trips"]
    parts = [
        df.select(F.lit(name).alias("grain"), *[c for c in keys if c in df.columns])
        for name, df in _grains(spark, folder).items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _part_days(spark, folder, *others):
    """Lines as trips: a day, a company and a vehicle number each; sets by day and ``others``,
    as stored. A key that no reader asks for would multiply the sets that each task holds."""
    rows = table(spark, folder, "lineitem").select(
        F.to_date("l_shipdate").alias("pickup_date"), F.col("l_returnflag").alias("company"),
        F.col("l_partkey").alias("vehicle"))
    path = f"{shared_folder(spark, 'vehicle-sets')}/daily"
    write_parquet(sets.set_rollup(rows, ["pickup_date", *others], "vehicle", passes=4), path)
    return spark.read.parquet(path)


@query("vehicles_by_month", """
SELECT strftime(l_shipdate, '%Y-%m') AS pickup_month, l_returnflag AS company, COUNT(*) AS trips,
       COUNT(DISTINCT l_partkey) AS vehicles, COUNT(*) / COUNT(DISTINCT l_partkey) AS trips_per_vehicle
FROM lineitem GROUP BY ALL""")
def vehicles_by_month(spark, folder):
    """Distinct vehicles of a month from the stored sets of its days."""
    days = _part_days(spark, folder, "company")
    months = days.withColumn("pickup_month", month_label(F.col("pickup_date")))
    return sets.trips_per_active(months, ["pickup_month", "company"])


@query("vehicles_all_grains", """
SELECT 'year' AS grain, CAST(year(l_shipdate) AS VARCHAR) AS period, COUNT(DISTINCT l_partkey) AS vehicles
FROM lineitem GROUP BY ALL
UNION ALL SELECT 'quarter', year(l_shipdate) || 'Q' || quarter(l_shipdate), COUNT(DISTINCT l_partkey)
FROM lineitem GROUP BY ALL
UNION ALL SELECT 'all', 'all', COUNT(DISTINCT l_partkey) FROM lineitem""")
def vehicles_all_grains(spark, folder):
    """Quarters are united from days, years from quarters, the total from years."""
    day = F.col("pickup_date")
    quarters = sets.merge_sets(_part_days(spark, folder).withColumns({
        "year": F.year(day).cast("string"),
        "quarter": F.concat(F.year(day), F.lit("Q"), F.quarter(day))}), ["year", "quarter"])
    years = sets.merge_sets(quarters, ["year"])
    whole = years.withColumn("all", F.lit("all"))
    found = [sets.set_sizes(df, [key]).select(
        F.lit(key).alias("grain"), F.col(key).alias("period"), "vehicles")
        for df, key in ((years, "year"), (quarters, "quarter"), (whole, "all"))]
    return union_sources(found)
