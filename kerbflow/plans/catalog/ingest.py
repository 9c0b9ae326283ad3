"""Links, month bookkeeping, manifests and the streaming rollup."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kerbflow.functions.timeparts import month_label
from kerbflow.operators.rollup import base_rollup, between_times, five_grains
from kerbflow.operators.unify import union_sources
from kerbflow.plans.catalog.registry import query
from kerbflow.plans.catalog.standins import (
    MONTHS,
    SCHEMAS,
    TRIPS,
    ZONES,
    event_trips,
    month_counts,
    order_range,
    table,
    zones,
)
from kerbflow.plans.monthly import refresh_months, stored_grain
from kerbflow.session import shared_folder
from kerbflow.sources import incremental as inc
from kerbflow.sources import links
from kerbflow.sources.sinks import manifest, write_parquet
from kerbflow.sources.snapshots import SnapshotStore
from kerbflow.streaming import eventtime, hourly


@query("link_discovery", r"""WITH l AS (
  SELECT page_id, regexp_extract_all(regexp_replace(html,
    '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'),
    '(?is)<a\s[^>]*>.*?</a\s*>') AS anchors FROM pages),
a AS (SELECT page_id, unnest(anchors) AS anchor,
             CAST(unnest(range(len(anchors))) AS INTEGER) AS position FROM l)
SELECT page_id, position, regexp_extract(anchor, '(?i)href="([^"]*)"', 1) AS href,
       trim(regexp_replace(regexp_extract(anchor, '(?is)>(.*)</a', 1), '<[^>]*>', ' ', 'g'))
         AS label FROM a""")
def link_discovery(spark, folder):
    """Every anchor of every page; a scan without a shuffle."""
    return links.page_links(table(spark, folder, "pages"))


_FOLDER = "https://data.example/trip-data/"


def _link_pages(spark, folder):
    """A page per month with month links, decoys and markup; slow months lack one link."""
    month = F.col("month")

    def anchor(prefix, label, attrs=' class="x"'):
        return F.concat(
            F.lit(f'<li><a{attrs} href="{_FOLDER}{prefix}'), month, F.lit('.parquet">'),
            F.lit(label), F.lit("</a></li>"),
        )

    high = anchor("fhvhv_tripdata_", "High <b>Volume</b> &amp; more")
    html = F.concat(
        F.lit("<html><!-- <a href='/trip-data/fhv_tripdata_1990-01.parquet'>old</a> --><ul>"),
        F.when(F.col("busy"), high).otherwise(F.lit("")),
        anchor("fhv_tripdata_", " Base trips ", ""),
        anchor("yellow_tripdata_", "Yellow", "\n id='y'"),
        anchor("other_tripdata_", "Other"),
        F.lit(f'<a href="{_FOLDER}yellow_tripdata.parquet">no month</a>'),
        F.lit(f'<a href="{_FOLDER}notes.pdf">notes</a><a name="end">end</a></ul></html>'),
    )
    return month_counts(spark, folder).select(month.alias("page_id"), html.alias("html"))


@query("trip_record_links", f"""WITH {MONTHS}, t AS (
  SELECT month, busy, unnest([
    {{'k': 'hvfhv', 'p': 'fhvhv_tripdata_', 'l': 'High  Volume  & more'}},
    {{'k': 'fhv', 'p': 'fhv_tripdata_', 'l': 'Base trips'}},
    {{'k': 'yellow', 'p': 'yellow_tripdata_', 'l': 'Yellow'}}]) AS t FROM months)
SELECT month, month[1:4] AS year, t.k AS record_type, t.l AS label,
       '{_FOLDER}' || t.p || month || '.parquet' AS url
FROM t WHERE t.k <> 'hvfhv' OR busy""")
def trip_record_links(spark, folder):
    found = links.trip_record_links(links.page_links(_link_pages(spark, folder)))
    return found.drop(*links.PLACE)


@query("link_entities", """
SELECT p_partkey AS page_id, 0 AS position, '/x?a=1&b=' || p_partkey AS href,
       'A' || chr(CAST(161 + p_partkey % 400 AS INTEGER)) || chr(CAST(128512 + p_partkey % 60 AS INTEGER))
       || 'é&lt;&unknown;&' || chr(65533) || '"' || chr(39) AS label FROM part""")
def link_entities(spark, folder):
    """References by name, number and hexadecimal number; unknown ones stay."""
    key = F.col("p_partkey")
    html = F.format_string(
        '<p><a href="/x?a=1&amp;b=%d">A&#%d;&#x%x;&eacute;&amp;lt;&unknown;&&#xD800;&quot;&#39;</a>',
        key, 161 + key % 400, 128512 + key % 60)
    return links.page_links(table(spark, folder, "part").select(key.alias("page_id"), html.alias("html")))


def _all_months(spark, folder):
    return inc.month_range(order_range(spark, folder))


_RANGE = """range_ AS (
  SELECT strftime(unnest(generate_series((SELECT date_trunc('month', MIN(o_orderdate)) FROM orders),
         (SELECT MAX(o_orderdate) FROM orders), INTERVAL 1 MONTH)), '%Y-%m') AS month)"""


@query("link_urls", f"""WITH {MONTHS}, {_RANGE}
SELECT month, CASE WHEN busy THEN '{_FOLDER}fhvhv_tripdata_' || month || '.parquet'
       ELSE 'https://mirror.example/fhvhv_' || month || '.parquet' END AS url
FROM range_ LEFT JOIN months USING (month)""")
def link_urls(spark, folder):
    """The link found for a month, or the template's."""
    found = links.trip_record_links(links.page_links(_link_pages(spark, folder)))
    return links.month_urls(
        _all_months(spark, folder), found, "hvfhv", "https://mirror.example/fhvhv_%s.parquet"
    )


@query("month_range_latest", f"""WITH {_RANGE}
SELECT month FROM range_ ORDER BY month DESC LIMIT 12""")
def month_range_latest(spark, folder):
    return inc.latest_months(_all_months(spark, folder), 12)


def _stored(spark, folder):
    """(table_name, month): a priority's month is stored if it has 9/10 of the mean."""
    per_day = table(spark, folder, "orders").groupBy(
        F.col("o_orderpriority").alias("table_name"), F.to_date("o_orderdate").alias("day")
    ).agg(F.count(F.lit(1)).alias("n"))
    per_month = per_day.groupBy("table_name", month_label(F.col("day")).alias("month")).agg(
        F.sum("n").alias("n")
    )
    return per_month.filter(F.col("n") >= per_month.agg(0.9 * F.avg("n")).scalar())


@query("pending_months", f"""WITH {_RANGE}, counted AS (
  SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, COUNT(*) AS n
  FROM orders GROUP BY 1, 2),
stored AS (SELECT * FROM counted WHERE n >= (SELECT 0.9::DOUBLE * AVG(n) FROM counted)),
done AS (SELECT month FROM stored GROUP BY 1 HAVING COUNT(*) >= 5)
SELECT month FROM range_ WHERE month NOT IN (SELECT month FROM done)""")
def pending_months(spark, folder):
    return inc.pending_months(_all_months(spark, folder), _stored(spark, folder), 5)


def _available(spark, folder):
    """Months whose orders reach the mean."""
    return month_counts(spark, folder).filter("busy")


_AVAILABLE = f"""{MONTHS}, {_RANGE}, available AS (SELECT month FROM months WHERE busy)"""


@query("pending_zone_months", f"""WITH {_AVAILABLE}
SELECT month FROM range_ WHERE month NOT IN (SELECT month FROM available)""")
def pending_zone_months(spark, folder):
    stored = _available(spark, folder).withColumnRenamed("month", "pickup_month")
    return inc.pending_zone_months(_all_months(spark, folder), stored)


@query("month_gap_runs", f"""WITH {_AVAILABLE}, a AS (
  SELECT month, row_number() OVER (ORDER BY month) AS i FROM range_),
m AS (SELECT month, i - row_number() OVER (ORDER BY i) AS island FROM a
      WHERE month NOT IN (SELECT month FROM available))
SELECT MIN(month) AS first_month, MAX(month) AS last_month, COUNT(*) AS length
FROM m GROUP BY island""")
def month_gap_runs(spark, folder):
    return inc.gap_runs(_all_months(spark, folder), _available(spark, folder))


@query("months_until_gap", f"""WITH {_AVAILABLE}, a AS (
  SELECT month, row_number() OVER (ORDER BY month) AS i FROM range_),
f AS (SELECT i, month, month IN (SELECT month FROM available) AS ok FROM a),
stop AS (SELECT MIN(x.i) AS i FROM f x JOIN f y ON y.i = x.i + 1
         WHERE NOT x.ok AND NOT y.ok AND x.i > (SELECT MIN(i) FROM f WHERE ok))
SELECT month FROM f WHERE ok AND i < coalesce((SELECT i FROM stop), 1000000)""")
def months_until_gap(spark, folder):
    """Available months before the first two absent ones in a row."""
    return inc.until_gap(_all_months(spark, folder), _available(spark, folder), 2)


@query("manifest", f"""WITH {TRIPS}, {ZONES}, n AS (
  SELECT trips.*, borough FROM trips LEFT JOIN zones USING (location_id))
SELECT 'daily_by_company' AS table_name, COUNT(*) AS rows, MIN(pickup_date) AS first_date,
       MAX(pickup_date) AS last_date
FROM (SELECT DISTINCT pickup_date, company FROM n)
UNION ALL SELECT 'daily_by_borough', COUNT(*), MIN(pickup_date), MAX(pickup_date)
FROM (SELECT DISTINCT pickup_date, company, borough FROM n)
UNION ALL SELECT 'daily_by_zone', COUNT(*), MIN(pickup_date), MAX(pickup_date)
FROM (SELECT DISTINCT pickup_date, company, location_id FROM n)
UNION ALL SELECT 'hourly_by_company', COUNT(*), MIN(pickup_date), MAX(pickup_date)
FROM (SELECT DISTINCT pickup_date, company, hour FROM n)
UNION ALL SELECT 'weekday_hour_by_company', COUNT(*), NULL, NULL
FROM (SELECT DISTINCT weekday_num, company, hour FROM n)""")
def rollup_manifest(spark, folder):
    """All grains count on the stored base, so the trips are scanned once."""
    path = f"{shared_folder(spark, 'manifest')}/base"
    write_parquet(base_rollup(event_trips(spark, folder).drop("event_id", "value")), path)
    return manifest(five_grains(spark.read.parquet(path), zones(spark, folder)))


def _refresh(spark, folder, trips, out, source="s", months=None, overwrite=False):
    day = F.to_date("pickup_datetime")
    months = months or inc.month_range(trips.agg(F.min(day).alias("lo"), F.max(day).alias("hi")))

    def load(month):
        return between_times(trips, *inc.month_span(month))

    refresh_months(spark, months, load, zones(spark, folder), out, source, overwrite=overwrite)


def _order_trips(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderdate").alias("pickup_datetime"), F.col("o_orderstatus").alias("company"),
        F.lit(None).cast("long").alias("location_id"), F.col("o_totalprice").alias("tips"),
    )


@query("stored_weekday_hour", """
SELECT 's' AS source, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday_num,
       dayname(o_orderdate) AS weekday, 0 AS hour, o_orderstatus AS company, COUNT(*) AS trips,
       round(SUM(o_totalprice), 2) AS tips FROM orders GROUP BY ALL""")
def stored_weekday_hour(spark, folder):
    """Weekday and hour over all stored months, with every measure."""
    out = shared_folder(spark, "stored-weekday-hour")
    _refresh(spark, folder, _order_trips(spark, folder), out)
    grain = stored_grain(spark, out, "weekday_hour_by_company")
    return grain.withColumn("tips", F.round("tips", 2))


@query("stored_two_sources", f"""WITH {TRIPS}
SELECT source, pickup_month, CAST(SUM(n) AS BIGINT) AS trips FROM (
  SELECT 'events' AS source, pickup_month, COUNT(*) AS n FROM trips GROUP BY ALL
  UNION ALL
  SELECT 'clicks', pickup_month, COUNT(*) FROM trips WHERE company = 'click' GROUP BY ALL)
GROUP BY ALL""")
def stored_two_sources(spark, folder):
    """Two sources with the same months below one folder: each has its own due months."""
    out = shared_folder(spark, "stored-two-sources")
    trips = event_trips(spark, folder).drop("event_id", "value")
    _refresh(spark, folder, trips, out, "events")
    _refresh(spark, folder, trips.filter("company = 'click'"), out, "clicks")
    return stored_grain(spark, out, "daily_by_company").groupBy("source", "pickup_month").agg(
        F.sum("trips").alias("trips")
    )


@query("stored_rollups", f"""WITH {TRIPS}, {ZONES}
SELECT 's' AS source, pickup_month, pickup_date, borough, company, COUNT(*) AS trips
FROM trips LEFT JOIN zones USING (location_id) GROUP BY ALL""")
def stored_rollups(spark, folder):
    """The monthly refresh, run over the months of the table, and one stored grain."""
    out = shared_folder(spark, "stored-rollups")
    _refresh(spark, folder, event_trips(spark, folder).drop("event_id", "value"), out)
    return stored_grain(spark, out, "daily_by_borough")


@query("stored_snapshot", f"""WITH {TRIPS}, {ZONES}, n AS (
  SELECT pickup_month, pickup_date, borough, company, COUNT(*) AS trips
  FROM trips LEFT JOIN zones USING (location_id) GROUP BY ALL)
SELECT 1 AS snapshot, 'daily_by_borough' AS table_name, * FROM n
UNION ALL SELECT 2, 'daily_by_borough', * FROM n WHERE company = 'click'
UNION ALL SELECT 1, 'daily_by_company', pickup_month, pickup_date, NULL, company,
  CAST(SUM(trips) AS BIGINT) FROM n GROUP BY ALL
UNION ALL SELECT 2, 'daily_by_company', pickup_month, pickup_date, NULL, company,
  CAST(SUM(trips) AS BIGINT) FROM n WHERE company = 'click' GROUP BY ALL""")
def stored_snapshot(spark, folder):
    """Two grains before and after the months are refreshed with fewer trips: each
    snapshot shows both grains of the same refresh."""
    out = shared_folder(spark, "stored-snapshot")
    trips = event_trips(spark, folder).drop("event_id", "value")
    _refresh(spark, folder, trips, out)
    _refresh(spark, folder, trips.filter("company = 'click'"), out, overwrite=True)
    first = SnapshotStore(spark, out).latest() - 1  # the months fit one pass
    found = []
    for number in (first, first + 1):
        for grain in ("daily_by_borough", "daily_by_company"):
            df = stored_grain(spark, out, grain, snapshot=number)
            area = F.col("borough") if "borough" in df.columns else F.lit(None).cast("string")
            found.append(df.select(
                F.lit(number - first + 1).alias("snapshot"), F.lit(grain).alias("table_name"),
                "pickup_month", "pickup_date", area.alias("borough"), "company", "trips"))
    return union_sources(found)


@query("stream_hourly", f"""WITH {TRIPS}
SELECT pickup_date, hour, company, COUNT(*) AS trips FROM trips GROUP BY ALL""")
def stream_hourly(spark, folder):
    """The events file consumed as a stream gives the batch rollup."""
    home = shared_folder(spark, "stream-hourly")
    schema = StructType.fromDDL(SCHEMAS["events"])
    # A pattern, so that the table may be one file or a folder of files.
    trips = hourly.landed_trips(spark, f"{folder}/events.parque[t]", schema).select(
        F.col("ts").alias("pickup_datetime"), F.col("event_type").alias("company")
    )
    hourly.run_hourly_counts(trips, f"{home}/counts", f"{home}/checkpoint")
    return hourly.stored_hourly(spark, f"{home}/counts")


#: Every tenth event lands after the others, most of them hours behind the watermark.
LATE = "event_id % 10 = 3"


@query("stream_corrected", f"""WITH {TRIPS}, seen AS (
  SELECT MAX(pickup_datetime) - INTERVAL 1 HOUR AS watermark FROM trips WHERE NOT {LATE})
SELECT pickup_date, hour, company,
       COUNT(*) FILTER (WHERE NOT behind) AS published, COUNT(*) FILTER (WHERE behind) AS late,
       COUNT(*) AS trips
FROM (SELECT *, {LATE} AND date_trunc('hour', pickup_datetime) + INTERVAL 1 HOUR <= watermark AS behind
      FROM trips, seen) GROUP BY ALL""")
def stream_corrected(spark, folder):
    """Event-time hours with a watermark; the late trips land last and come as corrections."""
    home = shared_folder(spark, "stream-corrected")
    events = table(spark, folder, "events").select(
        F.col("ts").alias("pickup_datetime"), F.col("event_type").alias("company"), "event_id")
    for late in (f"NOT ({LATE})", LATE):
        events.filter(late).drop("event_id").write.mode("append").parquet(f"{home}/landing")
        landed = hourly.landed_trips(
            spark, f"{home}/landing", StructType.fromDDL("pickup_datetime timestamp_ntz, company string"))
        eventtime.run_corrected_hours(landed, f"{home}/hours", f"{home}/checkpoints")
    return eventtime.corrected_hours(spark, f"{home}/hours")
