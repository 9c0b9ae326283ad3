"""Hexagonal binning in column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_DEGREE = 111_320.0


def to_metres(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Local east/north offsets from an origin, good for a city-sized extent."""
    per_degree_east = METRES_PER_DEGREE * math.cos(math.radians(lat0))
    return (lon - lon0) * F.lit(per_degree_east), (lat - lat0) * F.lit(METRES_PER_DEGREE)


def hex_axial(x: Column, y: Column, radius: float) -> tuple[Column, Column]:
    """Axial (q, r) of the pointy-top hexagon that holds a point.

    The fractional cube coordinates are rounded, and the one with the largest
    rounding error is rebuilt from the other two.
    """
    q = (x * F.lit(math.sqrt(3.0) / 3.0) - y / F.lit(3.0)) / F.lit(radius)
    r = y * F.lit(2.0 / 3.0) / F.lit(radius)
    s = -q - r
    rq, rr, rs = (F.floor(v + F.lit(0.5)) for v in (q, r, s))
    eq, er, es = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    cell_q = F.when((eq > er) & (eq > es), -rr - rs).otherwise(rq)
    cell_r = F.when((eq > er) & (eq > es), rr).when(er > es, -rq - rs).otherwise(rr)
    return cell_q.cast("bigint"), cell_r.cast("bigint")
