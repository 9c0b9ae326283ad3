"""Spatial density, samples, centroids and located growth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.functions.hexcells import hex_axial, to_metres

# Map centre, hexagon radius in metres and sample size of the point map.
MAP_CENTRE = (40.735, -73.96)
HEX_RADIUS = 180.0
SAMPLE_POINTS = 80_000
SAMPLE_SEED = 42


def hex_density(
    points: DataFrame,
    radius: float = HEX_RADIUS,
    centre: tuple[float, float] = MAP_CENTRE,
    by: Sequence[str] = (),
) -> DataFrame:
    """Points per hexagonal cell; one hash aggregation, cells bounded by the extent."""
    x, y = to_metres(F.col("lat"), F.col("lon"), *centre)
    q, r = hex_axial(x, y, radius)
    located = points.dropna(subset=["lat", "lon"]).select(*by, q.alias("q"), r.alias("r"))
    return located.groupBy(*by, "q", "r").agg(F.count(F.lit(1)).alias("points"))


def point_sample(
    points: DataFrame, key: str, n: int = SAMPLE_POINTS, seed: int = SAMPLE_SEED,
    portable: bool = False,
) -> DataFrame:
    """The n points with the smallest seeded hash: repeatable at any partitioning.

    A histogram of the hash's leading bits gives the bucket in which the n-th point
    lies; rows beyond it are dropped in the scan, so that only about n rows (and
    not n per task) reach the final top-n. ``portable`` takes the slower MD5 of
    ``key-seed``, which other engines can repeat.
    """
    if portable:
        digest = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))
        bucket = F.substring("hash_", 1, 4)
    else:
        digest = F.xxhash64(F.lit(seed), F.col(key))
        bucket = F.shiftright("hash_", 48)
    hashed = points.withColumn("hash_", digest)
    counts = hashed.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    reached = F.sum("n").over(Window.orderBy("bucket"))
    cut = (
        counts.withColumn("reached", reached)
        .filter(F.col("reached") >= n)
        .agg(F.min("bucket"))
        .scalar()
    )
    near = hashed.filter(cut.isNull() | (bucket <= cut))
    return near.orderBy("hash_", key).limit(n).drop("hash_")


def ring_centroids(vertices: DataFrame, keys: Sequence[str] = ("location_id",)) -> DataFrame:
    """Area-weighted polygon centroids from (keys, ring, seq, x, y).

    Shoelace terms of consecutive vertices; holes run the other way round and
    subtract. A ring closes on its first vertex. The first vertex of the polygon
    is the origin, which keeps the cross products small for projected coordinates.
    """
    whole = Window.partitionBy(*keys).orderBy("ring", "seq")
    ring = Window.partitionBy(*keys, "ring").orderBy("seq")
    local = vertices.withColumns(
        {"x0": F.first("x").over(whole), "y0": F.first("y").over(whole)}
    ).withColumns({"px": F.col("x") - F.col("x0"), "py": F.col("y") - F.col("y0")})
    closed = local.withColumns(
        {
            "nx": F.coalesce(F.lead("px").over(ring), F.first("px").over(ring)),
            "ny": F.coalesce(F.lead("py").over(ring), F.first("py").over(ring)),
        }
    )
    cross = F.col("px") * F.col("ny") - F.col("nx") * F.col("py")
    sums = closed.groupBy(*keys).agg(
        F.first("x0").alias("x0"),
        F.first("y0").alias("y0"),
        F.sum(cross).alias("twice_area"),
        F.sum((F.col("px") + F.col("nx")) * cross).alias("sx"),
        F.sum((F.col("py") + F.col("ny")) * cross).alias("sy"),
    )
    whole_area = F.nullif(F.col("twice_area"), F.lit(0.0)) * 3
    return sums.select(
        *keys,
        (F.col("x0") + F.col("sx") / whole_area).alias("x"),
        (F.col("y0") + F.col("sy") / whole_area).alias("y"),
        (F.abs("twice_area") / 2).alias("area"),
    )


def locate_growth(ranked: DataFrame, centroids: DataFrame) -> DataFrame:
    """Ranked zones with coordinates and their share of the largest change."""
    spots = centroids.dropna(subset=["latitude", "longitude"]).select(
        "zone", "borough", "latitude", "longitude"
    )
    size = F.abs("trip_delta")
    largest = ranked.agg(F.max(size)).scalar()
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), size / F.nullif(largest, F.lit(0))))
    return ranked.join(spots, ["zone", "borough"]).withColumn("delta_share", share)
