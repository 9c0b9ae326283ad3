"""Merging overlapping sources by priority."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.functions.timeparts import month_label
from kerbflow.operators.rollup import UNKNOWN, re_sum, sums_of, unknown_area

LABEL = "month_label_read"


@dataclass(frozen=True)
class Source:
    """A rollup with its name and rank (the higher priority wins)."""

    name: str
    priority: int
    frame: DataFrame


def standard_columns(source: Source, granularity: str, company: str) -> DataFrame:
    """Default company, source, priority, granularity, month and year.

    The month is derived again from the date; the label read is kept aside for
    the month-label tie rule.
    """
    df = source.frame
    label = F.col("pickup_month") if "pickup_month" in df.columns else F.lit(None).cast("string")
    named = df if "company" in df.columns else df.withColumn("company", F.lit(company))
    return named.withColumns(
        {
            LABEL: label,
            "source": F.lit(source.name),
            "source_priority": F.lit(source.priority),
            "granularity": F.lit(granularity),
            "pickup_month": month_label(F.col("pickup_date")),
            "year": F.year("pickup_date"),
        }
    )


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """By-name union; a column absent from one source is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def best_source(df: DataFrame, keys: Sequence[str], tie: Sequence[Column] = ()) -> DataFrame:
    """One row per key from its highest-priority source.

    The rank filter is a group limit, so each task keeps one row per key before
    the shuffle and a key shared by many rows does not gather in one place.
    """
    order = [F.desc("source_priority"), *tie]
    ranked = df.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("rank_ = 1").drop("rank_")


def merge_sources(
    sources: Sequence[Source],
    keys: Sequence[str],
    granularity: str,
    company: str = "all",
    tie_break: str = "sum",
    dedup_level: str = "key",
) -> DataFrame:
    """Unified table over ``keys`` with one source per key.

    ``tie_break="sum"`` adds up all rows of the source that wins a key: they may differ
    in the month label read, in the licence or in the names of a place.
    ``"month_label"`` keeps the row with the highest label instead. A sum that no row of
    the winner has stays null. Of several names of a place a known one is kept, the
    greatest; of several licences the greatest. ``dedup_level="day"`` picks the source
    per date and company and keeps all its keys. Null areas count as 'Unknown'.
    """
    rows = union_sources([standard_columns(s, granularity, company) for s in sources])
    names = [c for c in ("borough", "zone") if c in rows.columns]
    if names:
        rows = rows.fillna(UNKNOWN, names)
    if tie_break == "month_label":
        return best_source(rows, keys, [F.desc_nulls_last(LABEL)]).drop(LABEL)
    carried = ["source", "source_priority", "granularity", "pickup_month", "year"]
    labels = [c for c in names if c not in keys]
    licences = [c for c in ("hvfhs_license_num",) if c in rows.columns and c not in keys]
    sums = [F.sum(c).alias(c) for c in sums_of(rows, [*keys, *carried, LABEL])]
    kept = [F.max(c).alias(c) for c in licences]
    if labels:
        known = [(F.col(c) != UNKNOWN).alias(f"known_{c}") for c in labels]
        kept.append(F.max(F.struct(*known, *labels)).alias("labels_"))
    summed = rows.groupBy(*keys, *carried).agg(*sums, *kept)
    for c in labels:
        summed = summed.withColumn(c, F.col(f"labels_.{c}"))
    summed = summed.drop("labels_")
    if dedup_level == "day":
        best = F.max("source_priority").over(Window.partitionBy("pickup_date", "company"))
        return summed.withColumn("best_", best).filter("source_priority = best_").drop("best_")
    return best_source(summed, keys, [F.asc("source")])


def daily_by_company(sources: Sequence[Source], **options) -> DataFrame:
    """Sources at any daily grain; places are summed away first."""
    flat = [Source(s.name, s.priority, _without_places(s.frame)) for s in sources]
    return merge_sources(flat, ["pickup_date", "company"], "daily", **options)


def daily_by_borough(sources: Sequence[Source], **options) -> DataFrame:
    """A source without boroughs enters under 'Unknown'."""
    placed = [
        s if "borough" in s.frame.columns else Source(s.name, s.priority, unknown_area(s.frame))
        for s in sources
    ]
    keys = ["pickup_date", "company", "borough"]
    return merge_sources(placed, keys, "daily_borough", **options)


def daily_by_zone(sources: Sequence[Source], **options) -> DataFrame:
    keys = ["pickup_date", "company", "location_id"]
    return merge_sources(sources, keys, "daily_zone", **options)


def hourly_by_company(sources: Sequence[Source], **options) -> DataFrame:
    return merge_sources(sources, ["pickup_date", "company", "hour"], "hourly", **options)


def _without_places(df: DataFrame) -> DataFrame:
    places = [c for c in ("borough", "location_id", "zone") if c in df.columns]
    if not places:
        return df
    rest = [c for c in ("pickup_date", "pickup_month", "company", "hvfhs_license_num")
            if c in df.columns]
    return re_sum(df.drop(*places), rest, absent_as_zero=False)


def annual_summary(daily: DataFrame) -> DataFrame:
    """Trips, first and last day and observed days per year and company."""
    per_day = daily.groupBy("year", "company", "pickup_date").agg(F.sum("trips").alias("trips"))
    return per_day.groupBy("year", "company").agg(
        F.sum("trips").alias("trips"),
        F.min("pickup_date").alias("first_date"),
        F.max("pickup_date").alias("last_date"),
        F.count("pickup_date").alias("days"),
    )
