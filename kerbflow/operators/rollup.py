"""Trip rollups.

Trips are scanned once into a base rollup at (date, hour, location, entity); its
size is bounded by the calendar and the dimensions, not by the trips, and map-side
partial aggregation collapses a hot company or zone before the shuffle. Every
coarser grain, every label and every dimension join works on that base.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbflow.functions.timeparts import month_label, weekday_label, weekday_name

# Measure columns of trip records and the names of their sums.
MEASURES = {
    "trip_miles": "trip_miles",
    "trip_time": "trip_time_seconds",
    "base_passenger_fare": "passenger_fare",
    "tips": "tips",
    "driver_pay": "driver_pay",
    "airport_fee": "airport_fees",
    "congestion_surcharge": "congestion_surcharges",
    "cbd_congestion_fee": "cbd_congestion_fees",
}
FLAGS = {"shared_request_flag": "shared_requests", "shared_match_flag": "shared_matches"}

DAY = ("pickup_date", "pickup_month")
GRAINS = {
    "daily_by_company": DAY,
    "daily_by_borough": (*DAY, "borough"),
    "daily_by_zone": (*DAY, "location_id", "borough", "zone"),
    "hourly_by_company": (*DAY, "hour"),
    "weekday_hour_by_company": ("weekday_num", "weekday", "hour"),
}
UNKNOWN = "Unknown"


def _total(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def count_trips(
    trips: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, str] = MEASURES,
    flags: Mapping[str, str] = FLAGS,
) -> DataFrame:
    """Rows, measure sums and flag counts per key; null keys are groups.

    Sums of columns the input lacks are left out; a sum of nulls is 0.
    """
    sums = [_total(F.col(c)).alias(o) for c, o in measures.items() if c in trips.columns]
    hits = [
        _total(F.col(c).cast("bigint")).alias(o)
        for c, o in flags.items()
        if c in trips.columns
    ]
    return trips.groupBy(*keys).agg(F.count(F.lit(1)).alias("trips"), *sums, *hits)


def re_sum(rollup: DataFrame, keys: Sequence[str], absent_as_zero: bool = True) -> DataFrame:
    """Sum every non-key column of a rollup to a coarser key.

    A sum over nulls only is 0, or stays null if ``absent_as_zero`` is off.
    """
    total = _total if absent_as_zero else F.sum
    return rollup.groupBy(*keys).agg(*[total(F.col(v)).alias(v) for v in sums_of(rollup, keys)])


def sums_of(rollup: DataFrame, keys: Sequence[str]) -> list[str]:
    """The numeric columns of a rollup that are no keys."""
    return [f.name for f in rollup.schema if f.name not in keys and _is_number(f)]


def _is_number(field) -> bool:
    return field.dataType.typeName() in ("byte", "short", "integer", "long", "double", "float")


def base_rollup(
    trips: DataFrame, entity: Sequence[str] = ("company",), location: bool = True
) -> DataFrame:
    """The one pass over trips: (pickup_date, hour[, location_id], *entity)."""
    place = ["location_id"] if location else []
    months = ["pickup_month"] if "pickup_month" in trips.columns else []
    keyed = trips.withColumns(
        {
            "pickup_date": F.to_date("pickup_datetime"),
            "hour": F.hour("pickup_datetime"),
        }
    )
    return count_trips(keyed, ["pickup_date", *months, "hour", *place, *entity])


def with_zone_names(
    rollup: DataFrame, zones: DataFrame, fill: str | None = None
) -> DataFrame:
    """Left join of the zone dimension; ``fill`` names unmatched zones.

    No broadcast hint: the planner broadcasts the dimension when its measured
    size is under the session's threshold and shuffles both sides otherwise.
    """
    named = rollup.join(zones.select("location_id", "borough", "zone"), "location_id", "left")
    return named.fillna(fill, ["borough", "zone"]) if fill is not None else named


def to_grain(rollup: DataFrame, grain: str, entity: Sequence[str] = ("company",)) -> DataFrame:
    """One of the five grains from a finer rollup (with zone names if needed)."""
    keys = GRAINS[grain]
    out = rollup
    if "pickup_month" in keys and "pickup_month" not in rollup.columns:
        out = out.withColumn("pickup_month", month_label(F.col("pickup_date")))
    if "weekday" in keys:
        out = out.withColumns(
            {
                "weekday_num": F.weekday("pickup_date"),
                "weekday": weekday_name(F.col("pickup_date")),
            }
        )
    drop = {"hour", "location_id", "weekday_num"} - set(keys)
    return re_sum(out.drop(*drop), [*keys, *entity])


def one_grain(
    trips: DataFrame, grain: str, zones: DataFrame | None = None,
    entity: Sequence[str] = ("company",), fill: str | None = None,
) -> DataFrame:
    """A single grain straight from the trips: one shuffle of partial counts.

    Place grains count per location first and look names up on the counts.
    """
    keys = GRAINS[grain]
    months = ["pickup_month"] if "pickup_month" in trips.columns else []
    keyed = trips.withColumn("pickup_date", F.to_date("pickup_datetime"))
    if "hour" in keys:
        keyed = keyed.withColumn("hour", F.hour("pickup_datetime"))
    if "weekday_num" in keys:
        keyed = keyed.withColumn("weekday_num", F.weekday("pickup_date"))
        counts = count_trips(keyed, ["weekday_num", "hour", *entity])
        return counts.withColumn("weekday", weekday_label(F.col("weekday_num")))
    place = ["location_id"] if "borough" in keys else []
    hour = ["hour"] if "hour" in keys else []
    counts = count_trips(keyed, ["pickup_date", *months, *hour, *place, *entity])
    if not months:
        counts = counts.withColumn("pickup_month", month_label(F.col("pickup_date")))
    if not place:
        return counts
    named = with_zone_names(counts, zones, fill)
    return named if grain == "daily_by_zone" else to_grain(named, grain, entity)


def five_grains(
    base: DataFrame,
    zones: DataFrame,
    entity: Sequence[str] = ("company",),
    fill: str | None = None,
    skip_zone: bool = False,
) -> dict[str, DataFrame]:
    """All grains; pass a base that was written out so that it is built once."""
    by_place = re_sum(base.drop("hour"), [*_day_keys(base), "location_id", *entity])
    named = with_zone_names(by_place, zones, fill)
    sources = {"daily_by_borough": named, "daily_by_zone": named}
    return {
        g: to_grain(sources.get(g, base), g, entity)
        for g in GRAINS
        if not (skip_zone and g == "daily_by_zone")
    }


def _day_keys(base: DataFrame) -> list[str]:
    return [k for k in DAY if k in base.columns]


def grouping_set_rollup(
    base: DataFrame, zones: DataFrame, entity: str = "company", fill: str | None = None
) -> DataFrame:
    """Daily, borough, zone, hourly and weekday-hour totals in one result.

    The sets expand the bounded base rollup, never the trips. ``grain`` names the
    set each row belongs to, so that nulls of a key and of a set stay apart.
    """
    rows = with_zone_names(base, zones, fill).withColumn("weekday_num", F.weekday("pickup_date"))
    keys = ["pickup_date", "hour", "weekday_num", "location_id", "borough", "zone", entity]
    sets = {
        "daily": ["pickup_date", entity],
        "borough": ["pickup_date", "borough", entity],
        "zone": ["pickup_date", "location_id", "borough", "zone", entity],
        "hourly": ["pickup_date", "hour", entity],
        "weekday_hour": ["weekday_num", "hour", entity],
    }
    absent = {
        name: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in used)
        for name, used in sets.items()
    }
    grain = reduce(
        lambda acc, item: F.when(F.col("set_id") == item[1], item[0]).otherwise(acc),
        absent.items(),
        F.lit(None).cast("string"),
    )
    return (
        rows.groupingSets([[F.col(k) for k in used] for used in sets.values()], *keys)
        .agg(F.grouping_id().alias("set_id"), F.sum("trips").alias("trips"))
        .withColumn("grain", grain)
        .drop("set_id")
    )


def zone_backfill(
    trips: DataFrame, zones: DataFrame, entity: Sequence[str], fill: str | None = None
) -> DataFrame:
    """Zone grain alone: rows without a location are dropped, only trips are counted."""
    keys = ["pickup_date", "pickup_month", *entity, "location_id"]
    located = trips.dropna(subset=["pickup_datetime", "location_id"])
    keyed = located.withColumn("pickup_date", F.to_date("pickup_datetime"))
    if "pickup_month" in trips.columns:
        counts = count_trips(keyed, keys, {}, {})
    else:
        counts = count_trips(keyed, [k for k in keys if k != "pickup_month"], {}, {})
        counts = counts.withColumn("pickup_month", month_label(F.col("pickup_date")))
    return with_zone_names(counts, zones, fill)


def area_from_zone(zone_daily: DataFrame, keys: Sequence[str] = (*DAY, "borough")) -> DataFrame:
    """Borough totals of a zone rollup; unmatched zones form one null borough."""
    values = zone_daily.select(*keys, "trips")
    return re_sum(values, keys)


def unknown_area(daily: DataFrame) -> DataFrame:
    """Borough rows of a source that has no places: all trips under 'Unknown'."""
    return daily.withColumn("borough", F.lit(UNKNOWN))


def between_times(trips: DataFrame, start: str, end: str, codes: Sequence[str] | None = None,
                  ts: str = "pickup_datetime", code: str = "company") -> DataFrame:
    """Half-open time range (and codes) as plain predicates the scan can push down."""
    lo, hi = (F.lit(t).cast("timestamp_ntz") for t in (start, end))
    kept = trips.filter((F.col(ts) >= lo) & (F.col(ts) < hi))
    return kept if codes is None else kept.filter(F.col(code).isin(*codes))


def by_day_and_place(trips: DataFrame, keys: Sequence[str] = ("location_id",)) -> DataFrame:
    """Counts per truncated day and the given keys."""
    day = F.date_trunc("day", F.col("pickup_datetime")).cast("date")
    return count_trips(trips.withColumn("pickup_date", day), ["pickup_date", *keys], {}, {})


def hourly_profile(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("hour").agg(F.sum("trips").alias("trips"))


def weekday_profile(daily: DataFrame) -> DataFrame:
    sums = daily.groupBy(F.weekday("pickup_date").alias("weekday_num")).agg(
        F.sum("trips").alias("trips")
    )
    return sums.withColumn("weekday", weekday_label(F.col("weekday_num")))


def heatmap(hourly: DataFrame) -> DataFrame:
    """Weekday rows by 24 hour columns ``h00``..``h23``; a missing cell is 0."""
    if "weekday_num" not in hourly.columns:
        hourly = hourly.withColumn("weekday_num", F.weekday("pickup_date"))
    names = [f"h{h:02d}" for h in range(24)]
    cells = [F.expr(f"sum(if(hour = {h}, trips, 0L)) AS {n}") for h, n in enumerate(names)]
    wide = hourly.groupBy("weekday_num").agg(*cells)
    return wide.select("weekday_num", weekday_label(F.col("weekday_num")).alias("weekday"), *names)
