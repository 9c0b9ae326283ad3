"""Distinct counts that can be summed up again: sets of numbers as bit masks.

A rollup keeps, for each key and bucket of 256 numbers, the members seen as four masks of
64 bits. Coarser keys are unions of masks, so months, quarters or areas are counted exactly
from stored days, without the trips. Members are whole numbers; dense ones (a number for
each vehicle) fill few buckets, sparse ones take a narrow row each, never more rows than
trips. Where an estimate is enough, ``sketch_rollup`` keeps one of bounded size instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET, SKETCH = "set_bucket", "member_sketch"
# Plain numbers, since a hash aggregate holds them in place: bitmap columns of some KB are
# sorted instead, and pack so well that partitions planned by their size are far too large.
MEMBERS = tuple(f"members_{i}" for i in range(4))


def set_rollup(
    trips: DataFrame, keys: Sequence[str], member: str, passes: int = 1
) -> DataFrame:
    """Trips and the set of ``member`` values by key and bucket; rows without a member
    count as trips under a null bucket with null masks.

    Members spread thin leave a task with nearly as many sets as trips. With more ``passes``
    the trips are read that often, for a part of the buckets each time. Of a scan, tasks of
    their own do each pass and hold that part only. Trips must be the same at each reading.
    """
    number = F.col(member).cast("bigint")
    word = F.shiftright(number, 6).bitwiseAND(F.lit(3))
    bit = F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), number.bitwiseAND(F.lit(63)).cast("int"))
    rows = trips.withColumn(BUCKET, F.shiftright(number, 8))
    if passes > 1:
        part = F.pmod(F.xxhash64(BUCKET), F.lit(passes))
        rows = reduce(DataFrame.union, [rows.filter(part == i) for i in range(passes)])
    return rows.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("trips"), *[
        F.bit_or(F.when(word == i, bit)).alias(m) for i, m in enumerate(MEMBERS)])


def merge_sets(rollup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rollup at a coarser key: trips added, sets united bucket by bucket."""
    return rollup.groupBy(*keys, BUCKET).agg(
        F.sum("trips").alias("trips"), *[F.bit_or(m).alias(m) for m in MEMBERS])


def set_sizes(rollup: DataFrame, keys: Sequence[str], name: str = "vehicles") -> DataFrame:
    """Trips and distinct members by key; the shuffle carries a row a key and bucket."""
    size = sum(F.coalesce(F.bit_count(m), F.lit(0)) for m in MEMBERS)
    return merge_sets(rollup, keys).groupBy(*keys).agg(
        F.sum("trips").alias("trips"), F.sum(size).alias(name))


def trips_per_active(rollup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trips over the distinct vehicles of the whole key (null without vehicles), where
    adding up daily counts would take a vehicle once a day."""
    return set_sizes(rollup, keys).withColumn(
        "trips_per_vehicle", F.col("trips") / F.nullif("vehicles", F.lit(0)))


def sketch_rollup(trips: DataFrame, keys: Sequence[str], member: str, bits: int = 12) -> DataFrame:
    """Trips and a sketch of the distinct members; ``bits`` 12 means some 1.6 % error."""
    return trips.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trips"), F.hll_sketch_agg(member, bits).alias(SKETCH))


def sketch_sizes(rollup: DataFrame, keys: Sequence[str], name: str = "vehicles") -> DataFrame:
    """Estimated distinct members at a coarser key, from stored sketches."""
    return rollup.groupBy(*keys).agg(
        F.sum("trips").alias("trips"), F.hll_sketch_estimate(F.hll_union_agg(SKETCH)).alias(name))
