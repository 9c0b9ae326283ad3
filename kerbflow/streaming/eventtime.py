"""Hourly counts by event time in the state store, with corrections for late trips.

Two queries read the landing folder. The first keeps the open hours in Spark's state:
with a watermark its size is bounded by the hours within the delay, and each batch emits
the totals that changed. What comes behind the watermark no longer reaches that state.
The second counts what each batch brings, whatever its age. Corrections are the difference
of the two, so an hour published too small is restated and no trip is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbflow.sources.readers import read_optional
from kerbflow.streaming.hourly import COUNTS, run_hourly_counts, stored_hourly

KEYS = ("pickup_date", "hour", "company")


def run_open_hours(trips: DataFrame, out: str, checkpoint: str, delay: str) -> None:
    """Tumbling hours by company in update mode; each batch stores the totals it changed.

    A batch that is replayed overwrites its own folder. ``trips`` has pickup_datetime
    and company; trips without a time are left to the corrections. A watermark needs
    instants, so clock times are read in the session's time zone (UTC has all hours).
    """
    hours = (
        trips.select(F.col("pickup_datetime").cast("timestamp").alias("at"), "company")
        .withWatermark("at", delay)
        .groupBy(F.window("at", "1 hour").alias("w"), "company")
        .agg(F.count(F.lit(1)).alias("trips"))
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.select(
            F.to_date("w.start").alias("pickup_date"), F.hour("w.start").alias("hour"), "company", "trips"
        ).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = (
        hours.writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def published_hours(spark: SparkSession, out: str) -> DataFrame:
    """The last total that the state gave for each hour."""
    rows = read_optional(spark, f"{out}/open", f"{COUNTS}, batch_id long")
    return rows.groupBy(*KEYS).agg(F.max_by("trips", "batch_id").alias("trips"))


def landed_hours(spark: SparkSession, out: str) -> DataFrame:
    """What has landed in each hour, late trips included."""
    return stored_hourly(spark, f"{out}/landed")


def corrections(spark: SparkSession, out: str) -> DataFrame:
    """Landed less published trips of the hours where they differ."""
    signed = landed_hours(spark, out).unionByName(
        published_hours(spark, out).withColumn("trips", -F.col("trips")))
    return signed.groupBy(*KEYS).agg(F.sum("trips").alias("trips")).filter("trips <> 0")


def run_corrected_hours(trips: DataFrame, out: str, home: str, delay: str = "1 hour") -> None:
    """Take in what has landed: open hours first, then the counts of the same files.

    ``home`` holds the checkpoints. If the second query fails, its files are counted by
    the next run; until then the corrections are those of the files that both have seen.
    """
    run_open_hours(trips, f"{out}/open", f"{home}/open", delay)
    run_hourly_counts(trips, f"{out}/landed", f"{home}/landed")


def corrected_hours(spark: SparkSession, out: str) -> DataFrame:
    """Hourly totals as published, the late trips added to them, and their sum."""
    published = published_hours(spark, out).withColumnRenamed("trips", "published")
    late = corrections(spark, out).withColumnRenamed("trips", "late")
    both = published.unionByName(late, allowMissingColumns=True)
    sums = both.groupBy(*KEYS).agg(
        F.coalesce(F.sum("published"), F.lit(0)).alias("published"),
        F.coalesce(F.sum("late"), F.lit(0)).alias("late"))
    return sums.withColumn("trips", F.col("published") + F.col("late"))
