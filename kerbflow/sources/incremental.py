"""Which months are due."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def month_bounds(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row (lo, hi) from two month labels."""
    return spark.range(1).select(
        F.to_date(F.lit(f"{start}-01")).alias("lo"), F.to_date(F.lit(f"{end}-01")).alias("hi")
    )


def month_range(ranges: DataFrame) -> DataFrame:
    """All month labels of each (lo, hi) row of dates."""
    months = F.sequence(F.trunc("lo", "MM"), F.trunc("hi", "MM"), F.expr("interval 1 month"))
    return ranges.select(F.explode(months).alias("day")).select(
        F.date_format("day", "yyyy-MM").alias("month")
    )


def month_span(month: str) -> tuple[str, str]:
    """First day of a month label and of the month after, for a half-open filter."""
    year, number = map(int, month.split("-"))
    after = (year + 1, 1) if number == 12 else (year, number + 1)
    return f"{month}-01", f"{after[0]:04d}-{after[1]:02d}-01"


def latest_months(months: DataFrame, n: int) -> DataFrame:
    return months.orderBy(F.desc("month")).limit(n)


def pending_months(months: DataFrame, stored: DataFrame, tables: int) -> DataFrame:
    """Months for which not all ``tables`` tables are stored.

    ``stored`` has (table_name, month) rows.
    """
    complete = (
        stored.select("table_name", "month")
        .distinct()
        .groupBy("month")
        .agg(F.count(F.lit(1)).alias("have"))
        .filter(F.col("have") >= tables)
    )
    return months.join(complete, "month", "left_anti")


def pending_zone_months(months: DataFrame, zone_table: DataFrame) -> DataFrame:
    """Months without any row in the stored zone table."""
    filled = zone_table.groupBy(F.col("pickup_month").alias("month")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return months.join(filled.filter("rows > 0"), "month", "left_anti")


def until_gap(months: DataFrame, available: DataFrame, patience: int = 3) -> DataFrame:
    """Available months before the first run of ``patience`` absent ones.

    A run counts only after some month was found. One row per month, so the
    ordered window is calendar-sized.
    """
    order = Window.orderBy("month")
    seen = available.select("month", F.lit(1).alias("found")).distinct()
    flags = months.join(seen, "month", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    runs = flags.withColumn("block", F.sum("found").over(order)).withColumn(
        "misses",
        F.sum(1 - F.col("found")).over(Window.partitionBy("block").orderBy("month")),
    )
    stopped = F.max(
        ((F.col("misses") >= patience) & (F.col("block") > 0)).cast("int")
    ).over(order)
    return runs.withColumn("stopped", stopped).filter("found = 1 AND stopped = 0").select("month")


def gap_runs(months: DataFrame, available: DataFrame) -> DataFrame:
    """Each run of absent months: first_month, last_month, length."""
    order = Window.orderBy("month")
    seen = available.select("month", F.lit(1).alias("found")).distinct()
    flags = months.join(seen, "month", "left").withColumn("block", F.count("found").over(order))
    return (
        flags.filter("found IS NULL")
        .groupBy("block")
        .agg(
            F.min("month").alias("first_month"),
            F.max("month").alias("last_month"),
            F.count(F.lit(1)).alias("length"),
        )
        .drop("block")
    )
