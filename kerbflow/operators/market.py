"""Operator comparison: trips per vehicle and rank by volume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.session import shared_folder


def trips_per_vehicle(supply: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trips over active vehicles per key (null without vehicles)."""
    return (
        supply.groupBy(*keys)
        .agg(F.sum("trips").alias("trips"), F.sum("vehicles").alias("vehicles"))
        .withColumn("trips_per_vehicle", F.col("trips") / F.nullif("vehicles", F.lit(0)))
    )


def competitor_rank(supply: DataFrame, operator: str, tasks: int | None = None) -> DataFrame:
    """Operators ranked by trips, equal volumes sharing a rank.

    The totals are written once in ranges of (trips, operator), so operators that share
    a volume are spread like others. Each range ranks its own rows; what lies before a
    range comes from a prefix sum over the ranges, one row each. A volume that goes on
    from the range before keeps the rank it had where it began. ``tasks``: ranges, by
    default as many as the shuffle gives.
    """
    spark = supply.sparkSession
    totals = supply.groupBy(operator).agg(
        F.sum("trips").alias("trips"), F.sum("vehicles").alias("vehicles")
    )
    order = [F.desc_nulls_last("trips"), F.asc(operator)]
    ranges = totals.repartitionByRange(tasks, *order) if tasks else totals.repartitionByRange(*order)
    path = shared_folder(spark, "operator-volumes")
    ranges.withColumn("part_", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn(
        "inside_", F.rank().over(Window.partitionBy("part_").orderBy(F.desc_nulls_last("trips"))))
    parts = rows.groupBy("part_").agg(
        F.count(F.lit(1)).alias("n_"), F.max("inside_").alias("last_rank"),
        F.min_by(F.struct("trips"), "inside_")["trips"].alias("top"),
        F.max_by(F.struct("trips"), "inside_")["trips"].alias("bottom"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    parts = parts.withColumns({
        "before_": F.coalesce(F.sum("n_").over(before), F.lit(0)),
        "goes_on": F.coalesce(F.lag(F.struct("bottom")).over(Window.orderBy("part_"))
                              .eqNullSafe(F.struct(F.col("top").alias("bottom"))), F.lit(False)),
    })
    begins = F.when(~(F.col("goes_on") & F.col("top").eqNullSafe(F.col("bottom"))),
                    F.col("before_") + F.col("last_rank"))
    parts = parts.withColumn("open_rank", F.last(begins, ignorenulls=True).over(before))
    known = parts.select("part_", "before_", "goes_on", "open_rank")
    rank = F.when(F.col("goes_on") & (F.col("inside_") == 1), F.col("open_rank")).otherwise(
        F.col("before_") + F.col("inside_"))
    return rows.join(known, "part_").select(operator, "trips", "vehicles", rank.alias("rank"))
