"""Table sinks and manifests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """Headed CSV for export; rows are sorted only if an order is given."""
    out = df.orderBy(*order) if order else df
    out.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_months(
    df: DataFrame, path: str, partitions: Sequence[str] = ("source", "pickup_month")
) -> None:
    """Replace the partitions that occur in ``df``; all others stay.

    The rebalance hint gathers small partitions into full files and splits large
    ones, so that a heavy month is not written by one task.
    """
    df.hint("rebalance", *partitions).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*partitions).parquet(path)


def write_unless_empty(df: DataFrame, path: str) -> bool:
    """Write a table, but keep the stored one when the new result has no rows."""
    if df.isEmpty() and is_stored(df.sparkSession, path):
        return False
    write_parquet(df, path)
    return True


def is_stored(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def table_stats(name: str, df: DataFrame, day: str = "pickup_date") -> DataFrame:
    """Row count and day range of one table."""
    dated = day in df.columns
    none = F.lit(None).cast("date")
    return df.agg(
        F.lit(name).alias("table_name"),
        F.count(F.lit(1)).alias("rows"),
        (F.min(day) if dated else none).alias("first_date"),
        (F.max(day) if dated else none).alias("last_date"),
    )


def manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table."""
    return reduce(
        lambda a, b: a.unionByName(b), [table_stats(n, df) for n, df in tables.items()]
    )


def write_manifest(stats: DataFrame, path: str, params: Mapping[str, str]) -> None:
    """JSON lines: table statistics beside the run's parameters."""
    kept = stats.withColumns({k: F.lit(str(v)) for k, v in params.items()})
    kept.coalesce(1).write.mode("overwrite").json(path)
