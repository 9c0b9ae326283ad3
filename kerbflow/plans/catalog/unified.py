"""Source merging queries.

Four overlapping date slices of the orders play the sources: points (10), records
(20), bases (30) and high volume (40). The records leave one area null that the
bases call 'Unknown', and only the high-volume slice has a fare sum.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbflow.functions.timeparts import month_label
from kerbflow.operators import unify
from kerbflow.operators.unify import Source
from kerbflow.plans import corrections
from kerbflow.plans.catalog.registry import query
from kerbflow.plans.catalog.standins import (
    DEMAND,
    TRIPS,
    event_trips,
    named_demand,
    table,
)
from kerbflow.session import shared_folder
from kerbflow.sources.incremental import month_span
from kerbflow.sources.snapshots import SnapshotStore

#: Priority, first day and day after the last; None: open.
SLICES = {
    "points": (10, None, "1996-07-01"),
    "records": (20, "1996-01-01", "1997-07-01"),
    "bases": (30, "1997-01-01", "1999-07-01"),
    "high_volume": (40, "1999-01-01", None),
}
#: Points have no zones, so the zone table starts with the records.
ZONE_SLICES = {**{k: v for k, v in SLICES.items() if k != "points"},
               "records": (20, None, "1997-07-01")}


def _between(when, lo, hi):
    inside = F.lit(True)
    if lo:
        inside = inside & (when >= F.lit(lo).cast("timestamp_ntz"))
    if hi:
        inside = inside & (when < F.lit(hi).cast("timestamp_ntz"))
    return inside


def _between_sql(when, lo, hi):
    parts = [f"{when} >= DATE '{lo}'"] * bool(lo) + [f"{when} < DATE '{hi}'"] * bool(hi)
    return " AND ".join(parts) or "TRUE"


def _slice(name, slices=SLICES):
    return _between(F.col("o_orderdate"), *slices[name][1:])


def _order_source(spark, folder, name):
    """Orders per day of a slice; the newest slice also sums a fare."""
    rows = table(spark, folder, "orders").filter(_slice(name))
    sums = [F.count(F.lit(1)).alias("trips")]
    if name == "high_volume":
        sums.append(F.sum("o_totalprice").alias("passenger_fare"))
    day = F.to_date("o_orderdate").alias("pickup_date")
    return Source(name, SLICES[name][0], rows.groupBy(day).agg(*sums))


def _area_source(spark, folder, name):
    rows = named_demand(spark, folder, _slice(name))
    asia = {"records": F.lit(None).cast("string"), "bases": F.lit("Unknown")}
    if name in asia:
        is_asia = F.col("borough") == "ASIA"
        rows = rows.withColumn("borough", F.when(is_asia, asia[name]).otherwise(F.col("borough")))
    by = ["pickup_date", "borough"]
    return Source(name, SLICES[name][0], rows.groupBy(*by).agg(F.sum("trips").alias("trips")))


def _zone_source(spark, folder, name):
    rows = named_demand(spark, folder, _slice(name, ZONE_SLICES))
    by = ["pickup_date", "location_id", "borough", "zone"]
    return Source(name, SLICES[name][0], rows.groupBy(*by).agg(F.sum("trips").alias("trips")))


_BEST = """QUALIFY ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY source_priority DESC) = 1"""


def _union_sql(columns, tables=None, slices=SLICES):
    parts = []
    for name, (priority, lo, hi) in slices.items():
        parts.append(
            f"SELECT {columns.format(name=name)}, '{name}' AS source, {priority} AS source_priority "
            f"FROM {tables} WHERE {_between_sql('pickup_date', lo, hi)}"
        )
    return " UNION ALL ".join(parts)


@query("unified_daily_company", f"""WITH days AS (
  SELECT CAST(o_orderdate AS DATE) AS pickup_date, COUNT(*) AS trips,
         SUM(o_totalprice) AS fare FROM orders GROUP BY 1),
src AS ({_union_sql("pickup_date, trips, CASE WHEN '{name}' = 'high_volume' THEN fare END "
                    "AS fare", "days")})
SELECT pickup_date, 'all' AS company, source, source_priority, 'daily' AS granularity,
       strftime(pickup_date, '%Y-%m') AS pickup_month,
       CAST(year(pickup_date) AS INTEGER) AS year, trips, round(fare, 2) AS passenger_fare
FROM src {_BEST.format(keys="pickup_date")}""")
def unified_daily_company(spark, folder):
    sources = [_order_source(spark, folder, n) for n in SLICES]
    return unify.daily_by_company(sources).withColumn(
        "passenger_fare", F.round("passenger_fare", 2)
    )


_AREA_CASE = """CASE WHEN borough IS NULL THEN 'Unknown' WHEN borough = 'ASIA' AND '{name}' IN
  ('records', 'bases') THEN 'Unknown' WHEN '{name}' = 'points' THEN 'Unknown' ELSE borough END
  AS borough, pickup_date, trips"""


def _area_sql(best):
    return f"""WITH {DEMAND},
src AS ({_union_sql(_AREA_CASE, "demand")}),
summed AS (SELECT pickup_date, borough, source, source_priority,
                  CAST(SUM(trips) AS BIGINT) AS trips FROM src GROUP BY ALL)
SELECT pickup_date, 'all' AS company, borough, source, source_priority,
       'daily_borough' AS granularity, strftime(pickup_date, '%Y-%m') AS pickup_month,
       CAST(year(pickup_date) AS INTEGER) AS year, trips
FROM summed {best}"""


@query("unified_daily_area", _area_sql(_BEST.format(keys="pickup_date, borough")))
def unified_daily_area(spark, folder):
    sources = [_order_source(spark, folder, "points")]
    sources += [_area_source(spark, folder, n) for n in ("records", "bases", "high_volume")]
    return unify.daily_by_borough(sources)


@query("unified_day_level", _area_sql(
    "QUALIFY source_priority = MAX(source_priority) OVER (PARTITION BY pickup_date)"))
def unified_day_level(spark, folder):
    """The best source per day, with all its areas."""
    sources = [_order_source(spark, folder, "points")]
    sources += [_area_source(spark, folder, n) for n in ("records", "bases", "high_volume")]
    return unify.daily_by_borough(sources, dedup_level="day")


@query("unified_daily_zone", f"""WITH {DEMAND},
src AS ({_union_sql("pickup_date, location_id, borough, zone, trips", "demand", ZONE_SLICES)}),
summed AS (SELECT pickup_date, location_id, borough, zone, source, source_priority,
                  CAST(SUM(trips) AS BIGINT) AS trips FROM src GROUP BY ALL)
SELECT pickup_date, 'all' AS company, location_id, coalesce(borough, 'Unknown') AS borough,
       coalesce(zone, 'Unknown') AS zone, source, source_priority,
       'daily_zone' AS granularity, strftime(pickup_date, '%Y-%m') AS pickup_month,
       CAST(year(pickup_date) AS INTEGER) AS year, trips
FROM summed {_BEST.format(keys="pickup_date, location_id")}""")
def unified_daily_zone(spark, folder):
    return unify.daily_by_zone([_zone_source(spark, folder, n) for n in ZONE_SLICES])


@query("unified_two_licences", """WITH days AS (
  SELECT CAST(o_orderdate AS DATE) AS pickup_date, COUNT(*) AS trips, SUM(o_totalprice) AS fare,
         MAX(CASE o_orderstatus WHEN 'F' THEN 'HV1' WHEN 'O' THEN 'HV2' END) AS licence
  FROM orders GROUP BY 1)
SELECT pickup_date, 'Unknown' AS company, 'high_volume' AS source, 40 AS source_priority,
       'daily' AS granularity, strftime(pickup_date, '%Y-%m') AS pickup_month,
       CAST(year(pickup_date) AS INTEGER) AS year, trips, round(fare, 2) AS passenger_fare,
       licence AS hvfhs_license_num FROM days""")
def unified_two_licences(spark, folder):
    """Licences of one company on one day are added up, not chosen between."""
    day = F.to_date("o_orderdate").alias("pickup_date")
    licence = F.expr("CASE o_orderstatus WHEN 'F' THEN 'HV1' WHEN 'O' THEN 'HV2' END")
    rows = table(spark, folder, "orders").groupBy(day, licence.alias("hvfhs_license_num")).agg(
        F.count(F.lit(1)).alias("trips"), F.sum("o_totalprice").alias("passenger_fare")
    ).withColumn("company", F.lit("Unknown"))
    merged = unify.daily_by_company([Source("high_volume", 40, rows)])
    return merged.withColumn("passenger_fare", F.round("passenger_fare", 2))


@query("unified_zone_labels", f"""WITH {DEMAND}
SELECT pickup_date, 'all' AS company, location_id, max(borough) AS borough, max(zone) AS zone,
       'bases' AS source, 30 AS source_priority, 'daily_zone' AS granularity,
       strftime(pickup_date, '%Y-%m') AS pickup_month,
       CAST(year(pickup_date) AS INTEGER) AS year, CAST(SUM(trips) * 2 AS BIGINT) AS trips
FROM demand GROUP BY pickup_date, location_id""")
def unified_zone_labels(spark, folder):
    """One location under its name and under a null: both rows count."""
    by = ["pickup_date", "location_id", "borough", "zone"]
    rows = named_demand(spark, folder, F.lit(True)).groupBy(*by).agg(F.sum("trips").alias("trips"))
    none = F.lit(None).cast("string")
    unnamed = rows.withColumns({"borough": none, "zone": none})
    return unify.daily_by_zone([Source("bases", 30, rows.unionByName(unnamed))])


HOUR_SLICES = {
    "points": (10, None, "2024-01-12"),
    "bases": (30, "2024-01-08", "2024-01-22"),
    "high_volume": (40, "2024-01-18", None),
}
_HOUR_SRC = " UNION ALL ".join(
    f"SELECT pickup_date, hour, '{n}' AS source, {p} AS source_priority FROM trips "
    f"WHERE {_between_sql('pickup_datetime', lo, hi)}"
    for n, (p, lo, hi) in HOUR_SLICES.items()
)


@query("unified_hourly", f"""WITH {TRIPS}, src AS ({_HOUR_SRC}),
summed AS (SELECT pickup_date, hour, source, source_priority, COUNT(*) AS trips
           FROM src GROUP BY ALL)
SELECT pickup_date, 'all' AS company, hour, source, source_priority, 'hourly' AS granularity,
       strftime(pickup_date, '%Y-%m') AS pickup_month,
       CAST(year(pickup_date) AS INTEGER) AS year, trips
FROM summed {_BEST.format(keys="pickup_date, hour")}""")
def unified_hourly(spark, folder):
    sources = []
    for name, (priority, lo, hi) in HOUR_SLICES.items():
        when = F.col("pickup_datetime")
        rows = event_trips(spark, folder).filter(_between(when, lo, hi))
        counts = rows.groupBy(F.to_date(when).alias("pickup_date"), F.hour(when).alias("hour"))
        sources.append(Source(name, priority, counts.agg(F.count(F.lit(1)).alias("trips"))))
    return unify.hourly_by_company(sources)


def _labelled(spark, folder, name):
    """Rows of one day split over two month labels: pending orders carry the next month."""
    day = F.to_date("o_orderdate")
    later = F.col("o_orderstatus") == "P"
    rows = table(spark, folder, "orders").filter(_slice(name))
    counts = rows.groupBy(day.alias("pickup_date"), later.alias("later")).agg(
        F.count(F.lit(1)).alias("trips")
    )
    shown = F.when(F.col("later"), F.add_months("pickup_date", 1)).otherwise(F.col("pickup_date"))
    frame = counts.select("pickup_date", month_label(shown).alias("pickup_month"), "trips")
    return Source(name, SLICES[name][0], frame)


_LABELLED_SRC = _union_sql("pickup_date, label, trips", "labelled")


@query("unified_month_label_ties", f"""WITH labelled AS (
  SELECT CAST(o_orderdate AS DATE) AS pickup_date, COUNT(*) AS trips,
         strftime(CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 1 MONTH
                  ELSE o_orderdate END, '%Y-%m') AS label FROM orders GROUP BY ALL),
src AS ({_LABELLED_SRC})
SELECT pickup_date, 'all' AS company, source, source_priority, 'daily' AS granularity,
       strftime(pickup_date, '%Y-%m') AS pickup_month,
       CAST(year(pickup_date) AS INTEGER) AS year, trips
FROM src QUALIFY ROW_NUMBER() OVER (PARTITION BY pickup_date
                                    ORDER BY source_priority DESC, label DESC) = 1""")
def unified_month_label_ties(spark, folder):
    """Compatibility rule: of rows that differ in the label only, the highest label wins."""
    sources = [_labelled(spark, folder, n) for n in SLICES]
    return unify.merge_sources(
        sources, ["pickup_date", "company"], "daily", tie_break="month_label"
    )


@query("unified_month_label_sum", f"""WITH labelled AS (
  SELECT CAST(o_orderdate AS DATE) AS pickup_date, COUNT(*) AS trips, '' AS label
  FROM orders GROUP BY ALL),
src AS ({_LABELLED_SRC})
SELECT pickup_date, source, trips
FROM src QUALIFY ROW_NUMBER() OVER (PARTITION BY pickup_date ORDER BY source_priority DESC) = 1""")
def unified_month_label_sum(spark, folder):
    """Default rule: rows that differ in the label only are added up."""
    sources = [_labelled(spark, folder, n) for n in SLICES]
    return unify.daily_by_company(sources).select("pickup_date", "source", "trips")


@query("annual_summary", f"""WITH days AS (
  SELECT CAST(o_orderdate AS DATE) AS pickup_date, COUNT(*) AS trips FROM orders GROUP BY 1),
src AS ({_union_sql("pickup_date, trips", "days")}),
best AS (SELECT * FROM src {_BEST.format(keys="pickup_date")})
SELECT CAST(year(pickup_date) AS INTEGER) AS year, 'all' AS company,
       CAST(SUM(trips) AS BIGINT) AS trips, MIN(pickup_date) AS first_date,
       MAX(pickup_date) AS last_date, COUNT(DISTINCT pickup_date) AS days
FROM best GROUP BY 1""")
def annual_summary(spark, folder):
    sources = [_order_source(spark, folder, n) for n in SLICES]
    return unify.annual_summary(unify.daily_by_company(sources))


@query("union_shards", """
SELECT pickup_date, company, CAST(SUM(trips) AS BIGINT) AS trips,
       round(SUM(fare), 2) AS passenger_fare
FROM (SELECT CAST(o_orderdate AS DATE) AS pickup_date, o_orderstatus AS company, COUNT(*) AS trips,
             CASE WHEN o_orderstatus = 'F' THEN SUM(o_totalprice) ELSE 0 END AS fare
      FROM orders GROUP BY o_orderdate, o_orderstatus) GROUP BY 1, 2""")
def union_shards(spark, folder):
    """Shards with different columns and column orders, united by name and summed."""
    orders = table(spark, folder, "orders")
    day = F.to_date("o_orderdate").alias("pickup_date")
    count, company = F.count(F.lit(1)).alias("trips"), F.col("o_orderstatus").alias("company")
    narrow = orders.filter("o_orderstatus <> 'F'").groupBy(day, company).agg(count)
    wide = orders.filter("o_orderstatus = 'F'").groupBy(company, day).agg(
        F.sum("o_totalprice").alias("passenger_fare"), count
    )
    summed = unify.re_sum(unify.union_sources([narrow, wide]), ["pickup_date", "company"])
    return summed.withColumn("passenger_fare", F.round("passenger_fare", 2))


#: Months of two sources that are restated: some days go, of the others some orders.
RESTATED = {("bases", "1997-03"): "F", ("high_volume", "2000-02"): "O"}
_RESTATED_SQL = " AND ".join(
    f"NOT (name = '{n}' AND strftime(d, '%Y-%m') = '{m}' AND (day(d) BETWEEN 10 AND 12 "
    f"OR day(d) > 27 OR o_orderstatus = '{gone}'))" for (n, m), gone in RESTATED.items())
_CORRECTED = f"""WITH src AS ({" UNION ALL ".join(
    f"SELECT '{n}' AS name, {p} AS priority, CAST(o_orderdate AS DATE) AS d, o_orderstatus, "
    f"CASE WHEN '{n}' = 'high_volume' THEN o_totalprice END AS fare FROM orders "
    f"WHERE {_between_sql('o_orderdate', lo, hi)}" for n, (p, lo, hi) in SLICES.items())}),
summed AS (SELECT d, name, priority, COUNT(*) AS trips, SUM(fare) AS fare FROM src
           WHERE {_RESTATED_SQL} GROUP BY ALL),
best AS (SELECT * FROM summed QUALIFY ROW_NUMBER() OVER (PARTITION BY d ORDER BY priority DESC) = 1)"""


def _corrected_store(spark, folder):
    """Tables built once, then corrected month by month."""
    store = SnapshotStore(spark, shared_folder(spark, "corrections"))
    corrections.build(store, [_order_source(spark, folder, n) for n in SLICES])
    when = F.col("o_orderdate")
    for (name, month), gone in RESTATED.items():
        rows = table(spark, folder, "orders").filter(_slice(name)).filter(
            _between(when, *month_span(month))).filter(
            ~(F.dayofmonth(when).between(10, 12) | (F.dayofmonth(when) > 27)
              | (F.col("o_orderstatus") == gone)))
        sums = [F.count(F.lit(1)).alias("trips")]
        if name == "high_volume":
            sums.append(F.sum("o_totalprice").alias("passenger_fare"))
        frame = rows.groupBy(F.to_date(when).alias("pickup_date")).agg(*sums)
        corrections.correct_month(store, Source(name, SLICES[name][0], frame), month)
    return store


@query("unified_after_correction", f"""{_CORRECTED}
SELECT d AS pickup_date, 'all' AS company, name AS source, priority AS source_priority,
       strftime(d, '%Y-%m') AS pickup_month, trips, round(fare, 2) AS passenger_fare FROM best""")
def unified_after_correction(spark, folder):
    """The merged table after the deltas of two restated months equals a rebuild."""
    return corrections.unified_daily(_corrected_store(spark, folder)).withColumn(
        "passenger_fare", F.round("passenger_fare", 2))


@query("annual_after_correction", f"""{_CORRECTED}
SELECT CAST(year(d) AS INTEGER) AS year, 'all' AS company, CAST(SUM(trips) AS BIGINT) AS trips,
       MIN(d) AS first_date, MAX(d) AS last_date, COUNT(*) AS days FROM best GROUP BY 1""")
def annual_after_correction(spark, folder):
    return corrections.annual_summary(_corrected_store(spark, folder))
