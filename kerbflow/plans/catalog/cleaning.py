"""Cleaning and projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbflow.functions import cleaning as clean
from kerbflow.functions.timeparts import month_label, with_time_parts
from kerbflow.plans.catalog.registry import query
from kerbflow.plans.catalog.standins import table


@query("time_parts", """
SELECT event_id, CAST(ts AS DATE) AS pickup_date, strftime(ts, '%Y-%m') AS pickup_month,
       dayname(ts) AS weekday, CAST(isodow(ts) - 1 AS INTEGER) AS weekday_num,
       CAST(hour(ts) AS INTEGER) AS hour
FROM events WHERE event_type <> 'error'""")
def time_parts(spark, folder):
    """Text times, some unreadable, to calendar parts."""
    text = F.when(F.col("event_type") == "error", "no time").otherwise(F.col("ts").cast("string"))
    trips = table(spark, folder, "events").select(
        "event_id", clean.to_time(text).alias("pickup_datetime")
    )
    return with_time_parts(trips.dropna(subset=["pickup_datetime"])).drop("pickup_datetime")


@query("clean_numbers", """
SELECT upper(event_type) AS base,
       CASE event_type WHEN 'view' THEN 'Viewing' WHEN 'click' THEN 'Clicking'
            ELSE 'Unknown' END AS base_name,
       COUNT(*) AS rows,
       CAST(SUM(CASE WHEN event_type = 'error' THEN 0 ELSE CAST(round(value * 100) AS BIGINT)
                END) AS BIGINT) AS trips
FROM events GROUP BY 1, 2""")
def clean_numbers(spark, folder):
    """Numbers with separators and blanks, padded codes, names with a default."""
    cents = F.format_number(F.round(F.col("value") * 100).cast("bigint"), 0)
    raw = table(spark, folder, "events").select(
        F.concat(F.lit("  "), "event_type", F.lit(" ")).alias("base"),
        F.when(F.col("event_type") == "error", "abc")
        .otherwise(F.concat(F.lit(" "), cents, F.lit(" "))).alias("trips"),
    )
    base = clean.clean_code(F.col("base"))
    names = {"VIEW": "Viewing", "CLICK": "Clicking"}
    rows = raw.select(
        base.alias("base"),
        clean.lookup(base, names).alias("base_name"),
        clean.clean_count(F.col("trips")).alias("trips"),
    )
    return rows.groupBy("base", "base_name").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("trips").alias("trips")
    )


@query("flags_and_codes", """
SELECT l_returnflag AS code, l_linestatus = 'O' AND l_returnflag <> 'A' AS shared,
       COUNT(*) AS trips
FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2""")
def flags_and_codes(spark, folder):
    """Y / other / null flags to booleans; rows of the listed codes only."""
    flag = F.when(F.col("l_returnflag") == "A", F.lit(None).cast("string")).otherwise(
        F.when(F.col("l_linestatus") == "O", "Y").otherwise("N")
    )
    lines = table(spark, folder, "lineitem").select("l_returnflag", flag.alias("flag"))
    kept = lines.filter(F.col("l_returnflag").isin("A", "R"))
    return kept.groupBy(
        F.col("l_returnflag").alias("code"), clean.is_yes(F.col("flag")).alias("shared")
    ).agg(F.count(F.lit(1)).alias("trips"))


@query("month_from_label", """
SELECT CASE WHEN o_orderstatus = 'P' THEN strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m')
            ELSE strftime(o_orderdate, '%Y-%m') END AS file_month,
       strftime(o_orderdate, '%Y-%m') AS pickup_month, COUNT(*) AS trips
FROM orders GROUP BY 1, 2""")
def month_from_label(spark, folder):
    """The month a row's file was labelled with beside the month of its date."""
    day = F.to_date("o_orderdate")
    label = F.when(F.col("o_orderstatus") == "P", F.add_months(day, 1)).otherwise(day)
    per_day = table(spark, folder, "orders").groupBy(
        day.alias("pickup_date"), label.alias("label")
    ).agg(F.count(F.lit(1)).alias("n"))
    return per_day.groupBy(
        month_label(F.col("label")).alias("file_month"),
        month_label(F.col("pickup_date")).alias("pickup_month"),
    ).agg(F.sum("n").alias("trips"))
