"""Spatial queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from kerbflow.functions.hexcells import METRES_PER_DEGREE
from kerbflow.operators import growth, spatial
from kerbflow.plans.catalog.registry import query
from kerbflow.plans.catalog.standins import named_demand, table, zones
from kerbflow.plans.catalog.growth import _sql as growth_sql

LAT0, LON0 = spatial.MAP_CENTRE


def points(spark, folder):
    """Events at coordinates made from their user and id; some have none."""
    lon = F.lit(LON0) + (F.col("user_id") * 37 % 1001 - 500) * F.lit(0.0001)
    lat = F.lit(LAT0) + (F.col("event_id") * 17 % 1001 - 500) * F.lit(0.0001)
    return table(spark, folder, "events").select(
        "event_id", "event_type", lon.alias("lon"),
        F.when(F.col("event_type") != "error", lat).alias("lat"),
    )


_EAST = METRES_PER_DEGREE * math.cos(math.radians(LAT0))
_HEX = f"""WITH p AS (
  SELECT event_type, (({LON0}::DOUBLE + (user_id * 37 % 1001 - 500) * 0.0001::DOUBLE)
           - {LON0}::DOUBLE) * {_EAST!r}::DOUBLE AS x,
         (({LAT0}::DOUBLE + (event_id * 17 % 1001 - 500) * 0.0001::DOUBLE) - {LAT0}::DOUBLE)
           * {METRES_PER_DEGREE!r}::DOUBLE AS y
  FROM events WHERE event_type <> 'error'),
c AS (SELECT event_type, (x * {math.sqrt(3.0) / 3.0!r}::DOUBLE - y / 3.0::DOUBLE) / 180.0::DOUBLE
        AS q, y * {2.0 / 3.0!r}::DOUBLE / 180.0::DOUBLE AS r FROM p),
d AS (SELECT *, -q - r AS s FROM c),
f AS (SELECT *, floor(q + 0.5::DOUBLE) AS rq, floor(r + 0.5::DOUBLE) AS rr,
             floor(s + 0.5::DOUBLE) AS rs FROM d),
e AS (SELECT *, abs(rq - q) AS eq, abs(rr - r) AS er, abs(rs - s) AS es FROM f)
SELECT CAST(CASE WHEN eq > er AND eq > es THEN -rr - rs ELSE rq END AS BIGINT) AS q,
       CAST(CASE WHEN NOT (eq > er AND eq > es) AND er > es THEN -rq - rs ELSE rr END AS BIGINT)
         AS r, COUNT(*) AS points
FROM e GROUP BY 1, 2"""


@query("hex_density", _HEX)
def hex_density(spark, folder):
    return spatial.hex_density(points(spark, folder))


@query("point_sample", """
SELECT event_id, event_type FROM events
ORDER BY md5(CAST(event_id AS VARCHAR) || '-42'), event_id LIMIT 2000""")
def point_sample(spark, folder):
    """The sampling operator itself, with a sample smaller than the table."""
    sample = spatial.point_sample(points(spark, folder), "event_id", 2000, portable=True)
    return sample.select("event_id", "event_type")


def zone_vertices(spark, folder):
    """An L-shaped ring per customer, sized and placed by its keys."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    w, h = (key % 7 + 1).cast("double"), (key % 5 + 1).cast("double")
    x0, y0 = (key * 10).cast("double"), (nation * 10).cast("double")
    shape = [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]
    ring = F.array(
        *[F.struct((x0 + w * i).alias("x"), (y0 + h * j).alias("y")) for i, j in shape]
    )
    return table(spark, folder, "customer").select(
        key.alias("location_id"), F.lit(0).alias("ring"), F.posexplode(ring).alias("seq", "p")
    ).select("location_id", "ring", "seq", "p.x", "p.y")


@query("zone_centroids", """WITH s AS (
  SELECT c_custkey, c_custkey % 7 + 1 AS w, c_custkey % 5 + 1 AS h,
         c_custkey * 10 AS x0, c_nationkey * 10 AS y0 FROM customer)
SELECT c_custkey AS location_id, round(x0 + (2 * w * h * w + w * h * w / 2.0) / (3.0 * w * h), 6)
         ::DOUBLE AS x,
       round(y0 + (2 * w * h * h / 2.0 + w * h * 1.5 * h) / (3.0 * w * h), 6)::DOUBLE AS y,
       (3.0 * w * h)::DOUBLE AS area FROM s""")
def zone_centroids(spark, folder):
    """Checked against the centroid of the two rectangles each ring consists of."""
    out = spatial.ring_centroids(zone_vertices(spark, folder))
    return out.withColumns({c: F.round(c, 6) for c in ("x", "y", "area")})


def centroids(spark, folder):
    """Zone coordinates; the first zones have none."""
    key = F.col("location_id")
    return zones(spark, folder).select(
        "zone", "borough",
        F.when(key > 2, 40 + key / F.lit(100.0)).alias("latitude"),
        (-74 + key / F.lit(100.0)).alias("longitude"),
    )


_RANKED = growth_sql(12, ["zone", "borough"], """
ORDER BY trip_delta DESC, growth DESC NULLS LAST, zone NULLS LAST, borough NULLS LAST LIMIT 15""")


@query("zone_map", f"""WITH ranked AS ({_RANKED}), spots AS (
  SELECT zone, borough, CASE WHEN location_id > 2 THEN 40 + location_id / 100.0::DOUBLE END
           AS latitude, -74 + location_id / 100.0::DOUBLE AS longitude
  FROM (SELECT n_nationkey AS location_id, n_name AS zone, r_name AS borough
        FROM nation JOIN region ON n_regionkey = r_regionkey))
SELECT zone, borough, trip_delta, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
       round(abs(trip_delta) / (SELECT MAX(abs(trip_delta)) FROM ranked), 6) AS delta_share
FROM ranked JOIN spots USING (zone, borough)
WHERE latitude IS NOT NULL AND longitude IS NOT NULL""")
def zone_map(spark, folder):
    ranked = growth.growth_opportunities(
        named_demand(spark, folder), ["zone", "borough"], 12, top=15, volume_quantile=None
    )
    out = spatial.locate_growth(ranked, centroids(spark, folder))
    return out.select(
        "zone", "borough", "trip_delta",
        *[F.round(c, 6).alias(c) for c in ("latitude", "longitude", "delta_share")],
    )
