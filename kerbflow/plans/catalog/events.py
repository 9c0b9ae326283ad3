"""Event calendar and impact queries.

Suppliers play the custom event list: each stands for an event on a day derived from
its key, in its region, with aliased, blank and odd-case spellings. Areas are the
regions; one of them is left off the list of areas with a series of their own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbflow.functions.categories import event_category
from kerbflow.operators import events as ev
from kerbflow.plans.catalog.registry import query
from kerbflow.plans.catalog.standins import (
    DEMAND,
    HOLIDAYS,
    SPINE,
    context,
    named_demand,
    table,
)

AREAS = ("AFRICA", "AMERICA", "ASIA", "EUROPE")
HALF_WIDTH = 42


def _supplier_places(spark, folder):
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return (
        table(spark, folder, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    )


def event_seeds(spark, folder):
    """(event_name, event_category, dates[], venue, borough); two yearly dates each."""
    key = F.col("s_suppkey")
    first = F.date_add(F.lit("1995-02-01").cast("date"), (key * 37 % 2000).cast("int"))
    name = F.concat(F.lit("Fair "), (key % 40).cast("string"))
    return _supplier_places(spark, folder).select(
        F.when(key % 2 == 0, name).otherwise(F.concat(F.upper(name), F.lit(" "))).alias(
            "event_name"
        ),
        F.when(key % 5 == 0, "Concert").when(key % 5 == 1, " Sports ").when(key % 5 == 2, "")
        .when(key % 5 == 3, "Parade").alias("event_category"),
        F.array(first, F.date_add(first, 364)).alias("dates"),
        F.when(key % 3 == 0, F.col("n_name")).alias("venue"),
        F.when(key % 7 == 0, ev.EVERYWHERE).when(key % 11 == 0, "").when(
            key % 13 != 0, F.col("r_name")
        ).alias("borough"),
    )


SEEDS = """seeds AS (
  SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'Fair ' || (s_suppkey % 40)
              ELSE upper('Fair ' || (s_suppkey % 40)) || ' ' END AS event_name,
         CASE s_suppkey % 5 WHEN 0 THEN 'Concert' WHEN 1 THEN ' Sports ' WHEN 2 THEN ''
              WHEN 3 THEN 'Parade' END AS event_category,
         CAST(DATE '1995-02-01' + CAST(s_suppkey * 37 % 2000 AS INTEGER) AS DATE) AS d,
         CASE WHEN s_suppkey % 3 = 0 THEN n_name END AS venue,
         CASE WHEN s_suppkey % 7 = 0 THEN 'Multiple boroughs' WHEN s_suppkey % 11 = 0 THEN ''
              WHEN s_suppkey % 13 <> 0 THEN r_name END AS borough
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
                LEFT JOIN region ON n_regionkey = r_regionkey),
custom AS (SELECT DISTINCT d AS date, event_name, event_category, venue, borough FROM seeds
           UNION SELECT DISTINCT d + 364, event_name, event_category, venue, borough FROM seeds)"""


@query("event_seed", f"""WITH {SEEDS}
SELECT date, event_name, event_category, venue, borough FROM custom""")
def event_seed(spark, folder):
    return ev.expand_seeds(event_seeds(spark, folder))


def city_context(spark, folder):
    """Context with three yearly city events, one of them on a holiday in some years."""
    day = F.col("date")
    months_day = F.date_format(day, "MM-dd")
    city = (
        F.when(months_day == "06-30", "Pride Parade")
        .when(months_day == "08-28", "Tennis Open")
        .when(months_day == "11-11", "Charity Ball")
        .when(months_day == "12-31", "Year End")
    )
    return context(spark, folder).withColumn("nyc_event", city).withColumnRenamed(
        "date", "pickup_date"
    )


def calendar(spark, folder):
    return ev.event_calendar(
        city_context(spark, folder), ev.expand_seeds(event_seeds(spark, folder))
    )


CALENDAR = f"""{SPINE}, {HOLIDAYS}, {SEEDS}, city AS (
  SELECT date, CASE strftime(date, '%m-%d') WHEN '06-30' THEN 'Pride Parade'
         WHEN '08-28' THEN 'Tennis Open' WHEN '11-11' THEN 'Charity Ball'
         WHEN '12-31' THEN 'Year End' END AS event_name FROM spine),
parts AS (
  SELECT date, holiday_name AS event_name, 'Federal holiday' AS event_category,
         CAST(NULL AS VARCHAR) AS venue, CAST(NULL AS VARCHAR) AS borough, 1 AS src FROM holidays
  UNION ALL
  SELECT date, event_name,
         CASE event_name WHEN 'Pride Parade' THEN 'Parades & civic festivals'
              WHEN 'Tennis Open' THEN 'Sports' WHEN 'Charity Ball' THEN 'Concerts & music festivals'
              ELSE 'Civic / city event' END, NULL, NULL, 2
  FROM city WHERE event_name IS NOT NULL AND date NOT IN (SELECT date FROM holidays)
  UNION ALL
  SELECT date, event_name,
         CASE trim(event_category) WHEN 'Concert' THEN 'Concerts & music festivals'
              WHEN 'Parade' THEN 'Parades & civic festivals' WHEN 'Sports' THEN 'Sports'
              ELSE 'Other event' END, venue, borough, 3 FROM custom),
calendar AS (
  SELECT date, event_name, event_category, venue, borough FROM parts
  QUALIFY ROW_NUMBER() OVER (PARTITION BY date, lower(trim(event_name)), event_category
    ORDER BY src DESC, event_name DESC, venue DESC NULLS LAST, borough DESC NULLS LAST) = 1)"""


@query("event_calendar", f"WITH {CALENDAR} SELECT * FROM calendar")
def event_calendar(spark, folder):
    return calendar(spark, folder)


@query("event_categories", f"""WITH {CALENDAR}
SELECT event_category, COUNT(*) AS events, CAST(ROW_NUMBER() OVER (ORDER BY CASE event_category
    WHEN 'Federal holiday' THEN 1 WHEN 'Sports' THEN 2 WHEN 'Concerts & music festivals' THEN 3
    WHEN 'Parades & civic festivals' THEN 4 WHEN 'Convention / expo' THEN 5
    WHEN 'Civic / city event' THEN 6 WHEN 'Other event' THEN 7 END NULLS LAST, event_category)
  AS INTEGER) AS position
FROM calendar GROUP BY 1""")
def event_categories(spark, folder):
    return ev.ordered_categories(calendar(spark, folder))


@query("union_events", f"""WITH {CALENDAR}
SELECT src AS source, event_category, COUNT(*) AS events FROM parts GROUP BY 1, 2""")
def union_events(spark, folder):
    """The three event sources before de-duplication."""
    built_in = ev.context_events(city_context(spark, folder))
    custom = ev.expand_seeds(event_seeds(spark, folder)).withColumn("source_", F.lit(3))
    rows = built_in.unionByName(custom).withColumn(
        "event_category", event_category(F.col("event_category"))
    )
    return rows.groupBy(F.col("source_").alias("source"), "event_category").agg(
        F.count(F.lit(1)).alias("events")
    )


@query("event_scope", f"""WITH {CALENDAR}
SELECT * FROM calendar WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'
  AND event_category IN ('Sports', 'Other event', 'Federal holiday')
  AND (borough IS NULL OR borough IN ('ASIA', 'EUROPE', 'Multiple boroughs', ''))""")
def event_scope(spark, folder):
    return ev.events_in_scope(
        calendar(spark, folder), F.lit("1997-01-01").cast("date"),
        F.lit("1999-12-31").cast("date"), ["Sports", "Other event", "Federal holiday"],
        ["ASIA", "EUROPE"],
    )


@query("area_daily", f"""WITH {DEMAND}
SELECT pickup_date, borough, CAST(SUM(trips) AS BIGINT) AS trips,
       CAST(isodow(pickup_date) - 1 AS INTEGER) AS weekday_num
FROM demand WHERE borough IS NOT NULL GROUP BY 1, 2""")
def area_daily(spark, folder):
    out = ev.area_daily(named_demand(spark, folder))
    return out.withColumn("weekday_num", F.weekday("pickup_date"))


_IMPACT = f"""WITH {DEMAND}, {CALENDAR},
total AS (SELECT pickup_date AS d, CAST(SUM(trips) AS BIGINT) AS total FROM demand
          WHERE borough IS NOT NULL GROUP BY 1),
area AS (SELECT pickup_date AS d, borough, CAST(SUM(trips) AS BIGINT) AS trips FROM demand
         WHERE borough IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE') GROUP BY 1, 2),
series AS (SELECT borough AS series, d, trips, total FROM area JOIN total USING (d)
           UNION ALL SELECT 'ALL', d, total, total FROM total),
ev AS (SELECT c.*, CASE WHEN borough IN (SELECT borough FROM area) THEN borough ELSE 'ALL' END
         AS series FROM calendar c),
days AS (SELECT DISTINCT series, date FROM ev),
base AS (
  SELECT days.series, days.date, AVG(s.trips) AS baseline_trips,
         AVG(s.total - s.trips) AS control_baseline, COUNT(*) AS baseline_days
  FROM days JOIN series s ON s.series = days.series AND isodow(s.d) = isodow(days.date)
       AND s.d BETWEEN days.date - {HALF_WIDTH} AND days.date + {HALF_WIDTH}
  WHERE s.d NOT IN (SELECT date FROM calendar) GROUP BY 1, 2),
impact AS (
  SELECT ev.date, event_name, event_category, venue, borough, series, s.trips, baseline_trips,
         CASE WHEN baseline_trips > 0 THEN s.trips / baseline_trips - 1 END AS lift,
         CASE WHEN series <> 'ALL' AND control_baseline > 0
              THEN (s.total - s.trips) / control_baseline - 1 END AS control_lift,
         coalesce(baseline_days, 0) AS baseline_days
  FROM ev JOIN series s USING (series) LEFT JOIN base USING (series, date)
  WHERE s.d = ev.date)"""


def _impact(spark, folder):
    return ev.event_impact(
        named_demand(spark, folder), calendar(spark, folder), None, HALF_WIDTH, AREAS
    )


@query("event_impact", f"""{_IMPACT}
SELECT date, event_name, event_category, venue, borough, series, trips,
       round(baseline_trips, 6) AS baseline_trips, round(lift, 6) AS lift, baseline_days
FROM impact""")
def event_impact(spark, folder):
    out = _impact(spark, folder).drop("control_lift", "did_lift")
    return out.withColumns({c: F.round(c, 6) for c in ("baseline_trips", "lift")})


_UNPLACED = _IMPACT.replace("demand AS (", "placed AS (", 1).replace(f", {CALENDAR}", f""", demand AS (
  SELECT * REPLACE (CASE WHEN company IN ('BUILDING', 'MACHINERY') THEN NULL ELSE borough END AS borough)
  FROM placed), {CALENDAR}""", 1).replace("WHERE borough IS NOT NULL GROUP BY 1)", "GROUP BY 1)", 1)


@query("event_impact_unplaced", f"""{_UNPLACED}
SELECT date, event_name, event_category, series, trips, round(baseline_trips, 6) AS baseline_trips,
       round(lift, 6) AS lift, round(control_lift, 6) AS control_lift,
       round(lift - control_lift, 6) AS did_lift, baseline_days FROM impact""")
def event_impact_unplaced(spark, folder):
    """Two segments' trips have no area: they count in the city and in every control."""
    nowhere = F.col("company").isin("BUILDING", "MACHINERY")
    demand = named_demand(spark, folder).withColumn("borough", F.when(~nowhere, F.col("borough")))
    out = ev.event_impact(demand, calendar(spark, folder), None, HALF_WIDTH, AREAS).drop("venue", "borough")
    return out.withColumns({c: F.round(c, 6) for c in ("baseline_trips", "lift", "control_lift", "did_lift")})


@query("event_impact_city", f"""WITH {DEMAND}, {CALENDAR},
s AS (SELECT pickup_date AS d, CAST(SUM(trips) AS BIGINT) AS trips FROM demand GROUP BY 1),
base AS (
  SELECT days.date, AVG(s.trips) AS baseline_trips, COUNT(*) AS baseline_days
  FROM (SELECT DISTINCT date FROM calendar) days JOIN s ON isodow(s.d) = isodow(days.date)
       AND s.d BETWEEN days.date - {HALF_WIDTH} AND days.date + {HALF_WIDTH}
  WHERE s.d NOT IN (SELECT date FROM calendar) GROUP BY 1)
SELECT c.date, event_name, borough, 'ALL' AS series, s.trips,
       round(baseline_trips, 6) AS baseline_trips,
       round(CASE WHEN baseline_trips > 0 THEN s.trips / baseline_trips - 1 END, 6) AS lift,
       CAST(NULL AS DOUBLE) AS did_lift, coalesce(baseline_days, 0) AS baseline_days
FROM calendar c JOIN s ON s.d = c.date LEFT JOIN base ON base.date = c.date""")
def event_impact_city(spark, folder):
    """A table without areas: every event is measured on all trips, placed or not."""
    city = named_demand(spark, folder).select("pickup_date", "trips")
    out = ev.event_impact(city, calendar(spark, folder), None, HALF_WIDTH, AREAS)
    return out.select(
        "date", "event_name", "borough", "series", "trips",
        F.round("baseline_trips", 6).alias("baseline_trips"), F.round("lift", 6).alias("lift"),
        "did_lift", "baseline_days",
    )


@query("event_did", f"""{_IMPACT}
SELECT date, event_name, event_category, series, trips, round(control_lift, 6) AS control_lift,
       round(lift - control_lift, 6) AS did_lift FROM impact""")
def event_did(spark, folder):
    return _impact(spark, folder).select(
        "date", "event_name", "event_category", "series", "trips",
        F.round("control_lift", 6).alias("control_lift"), F.round("did_lift", 6).alias("did_lift"),
    )


@query("event_summary", f"""{_IMPACT}, g AS (
  SELECT event_category, COUNT(event_name) AS events, AVG(trips) AS avg_trips,
         AVG(baseline_trips) AS avg_baseline, AVG(lift) AS avg_lift,
         AVG(lift - control_lift) AS avg_did_lift FROM impact GROUP BY 1)
SELECT event_category, events, round(avg_trips, 6) AS avg_trips,
       round(avg_baseline, 6) AS avg_baseline, round(avg_lift, 6) AS avg_lift,
       round(avg_did_lift, 6) AS avg_did_lift, avg_did_lift IS NOT NULL AS did_available,
       round(coalesce(avg_did_lift, avg_lift), 6) AS plot_lift,
       CASE WHEN coalesce(avg_did_lift, avg_lift) >= 0 THEN 'Higher than baseline'
            ELSE 'Lower than baseline' END AS direction FROM g""")
def event_summary(spark, folder):
    out = ev.event_summary(_impact(spark, folder))
    names = ("avg_trips", "avg_baseline", "avg_lift", "avg_did_lift", "plot_lift")
    return out.withColumns({c: F.round(c, 6) for c in names})


@query("baseline_dates_semi", f"""WITH {DEMAND}, {CALENDAR}, b AS (
  SELECT DISTINCT CAST(s.date + CAST(7 * k AS INTEGER) AS DATE) AS d
  FROM calendar s, generate_series(-6, 6) t(k)
  WHERE CAST(s.date + CAST(7 * k AS INTEGER) AS DATE) NOT IN (SELECT date FROM calendar))
SELECT pickup_date, borough, CAST(SUM(trips) AS BIGINT) AS trips FROM demand
WHERE borough IS NOT NULL AND pickup_date IN (SELECT d FROM b) GROUP BY 1, 2""")
def baseline_dates_semi(spark, folder):
    """Area rows on any baseline day of any event."""
    events = calendar(spark, folder)
    days = events.select(F.lit(ev.ALL).alias("series"), F.col("date").alias("event_date"))
    baseline = ev.baseline_days(days.distinct(), events, HALF_WIDTH)
    return ev.area_daily(named_demand(spark, folder)).join(
        baseline.select(F.col("date").alias("pickup_date")), "pickup_date", "left_semi"
    )
