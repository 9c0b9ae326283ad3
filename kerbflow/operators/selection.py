"""Exact order statistics of any number of values, by refining a histogram.

Each round counts the values of a range in equal parts, keeps the part that holds the
wanted place and takes its least and greatest value as the next range. The driver sees
one row for each part; no task sorts or gathers the values.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 4096


def kth_smallest(values: DataFrame, k: int, column: str = "value"):
    """The value at place ``k`` (from 0) in ascending order; nulls and NaN are no values.

    ``values`` is read once a round: store what is dear to compute. A round narrows the
    range to one of PARTS, so whole numbers and doubles need about six at most.
    """
    v = F.col(column)
    kept = values.filter(v.isNotNull() & ~F.isnan(v.cast("double")))
    low, high = kept.agg(F.min(v), F.max(v)).first()
    if low is None:
        raise ValueError("there are no values")
    while low < high:
        inside = kept.filter((v >= low) & (v <= high))
        # Halves, so that the width of the range is finite for any two doubles.
        # The ends are in different parts, so each round narrows the range.
        share = (v * 0.5 - F.lit(low) * 0.5) / (F.lit(high) * 0.5 - F.lit(low) * 0.5)
        part = F.when(v == high, PARTS - 1).when(v == low, 0).otherwise(
            F.least(F.floor(share * PARTS).cast("int"), F.lit(PARTS - 1)))
        rows = inside.groupBy(part.alias("part")).agg(
            F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).collect()
        for row in sorted(rows, key=lambda r: r["part"]):  # PARTS rows at most
            if k < row["n"]:
                break
            k -= row["n"]
        low, high = row["low"], row["high"]
    return low


def exact_quantile(values: DataFrame, q: float, column: str = "value") -> float | None:
    """The value at share ``q`` of the way from the least to the greatest, interpolated
    between two neighbours as ``percentile`` does; None without values."""
    v = F.col(column)
    n = values.filter(v.isNotNull() & ~F.isnan(v.cast("double"))).count()
    if not n:
        return None
    place = q * (n - 1)
    first = kth_smallest(values, math.floor(place), column)
    if place == math.floor(place):
        return float(first)
    second = kth_smallest(values, math.floor(place) + 1, column)
    return float(first) + (float(second) - float(first)) * (place - math.floor(place))
