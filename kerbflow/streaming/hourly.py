"""Hourly counts from trips that keep landing as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kerbflow.sources.readers import read_optional


def landed_trips(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None
) -> DataFrame:
    """File source over a landing folder (or a pattern of folders and files)."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_hourly_counts(trips: DataFrame, out: str, checkpoint: str) -> None:
    """Process what has landed: each micro-batch adds its own partial counts.

    Counts add up, so no state has to be kept and no late trip is lost. A batch
    that is replayed after a failure overwrites its own folder, which makes the
    result exact. ``trips`` has pickup_datetime and company.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        keyed = batch.withColumns(
            {"pickup_date": F.to_date("pickup_datetime"), "hour": F.hour("pickup_datetime")}
        )
        counts = keyed.groupBy("pickup_date", "hour", "company").agg(
            F.count(F.lit(1)).alias("trips")
        )
        counts.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = (
        trips.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


FOLDED = "version long, last_batch long"
COUNTS = "pickup_date date, hour int, company string, trips long"


def _folded(spark: SparkSession, out: str) -> tuple[int, int]:
    """Latest folded version and the last batch in it (0 and -1: none)."""
    row = read_optional(spark, f"{out}_folded/log", FOLDED).agg(
        F.max(F.struct("version", "last_batch")).alias("x")
    ).first()
    return (row.x.version, row.x.last_batch) if row.x else (0, -1)


def stored_hourly(spark: SparkSession, out: str) -> DataFrame:
    """Hourly totals over the latest folded version and the batches after it."""
    version, last = _folded(spark, out)
    batches = read_optional(spark, out, f"{COUNTS}, batch_id long")
    rows = batches.filter(F.col("batch_id") > last)
    if version:
        old = spark.read.schema(COUNTS).parquet(f"{out}_folded/version={version}")
        rows = rows.drop("batch_id").unionByName(old)
    return rows.groupBy("pickup_date", "hour", "company").agg(F.sum("trips").alias("trips"))


def fold_batches(spark: SparkSession, out: str) -> None:
    """Add up all batches but the last, which may still be replayed, in one new version.

    The version counts once its log row is stored, so a run that fails in between
    changes nothing; folders of folded batches may then be deleted.
    """
    version, last = _folded(spark, out)
    batches = read_optional(spark, out, f"{COUNTS}, batch_id long").select("batch_id")
    newest = batches.agg(F.max("batch_id")).first()[0]
    if newest is None or newest - 1 <= last:
        return
    rows = read_optional(spark, out, f"{COUNTS}, batch_id long").filter(
        F.col("batch_id").between(last + 1, newest - 1)
    ).drop("batch_id")
    if version:
        rows = rows.unionByName(spark.read.schema(COUNTS).parquet(f"{out}_folded/version={version}"))
    rows.groupBy("pickup_date", "hour", "company").agg(F.sum("trips").alias("trips")).write.mode(
        "overwrite").parquet(f"{out}_folded/version={version + 1}")
    spark.createDataFrame([(version + 1, newest - 1)], FOLDED).coalesce(1).write.mode(
        "append").parquet(f"{out}_folded/log")
