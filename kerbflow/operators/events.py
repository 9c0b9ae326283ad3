"""Event calendar and event impact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.functions.categories import (
    CATEGORY_ORDER,
    category_from_name,
    event_category,
    rank_in,
)
from kerbflow.functions.cleaning import strip
from kerbflow.operators.filters import CORE_AREAS

COLUMNS = ["date", "event_name", "event_category", "venue", "borough"]
EVERYWHERE = "Multiple boroughs"
ALL = "ALL"


def expand_seeds(seeds: DataFrame) -> DataFrame:
    """(event_name, event_category, dates[], venue, borough) to one row per date."""
    return seeds.select(
        F.explode("dates").alias("date"), "event_name", "event_category", "venue", "borough"
    ).dropDuplicates()


def event_calendar(context: DataFrame, custom: DataFrame | None = None,
                   day: str = "pickup_date") -> DataFrame:
    """Holidays, city events that are not on a holiday, and custom events.

    Of events with the same date, name (ignoring case and blanks) and category the
    latest source wins, within a source the greatest name and place. Equal rows
    share that key, so no second de-duplication is needed.
    """
    rows = context_events(context, day)
    if custom is not None:
        rows = rows.unionByName(custom.select(*COLUMNS, F.lit(3).alias("source_")))
    return latest_event(
        rows.withColumn("event_category", event_category(F.col("event_category")))
    )


def context_events(context: DataFrame, day: str = "pickup_date") -> DataFrame:
    """Holiday (source 1) and city (source 2) events of each day, in one pass."""
    nothing = F.lit(None).cast("string")
    is_holiday = F.coalesce(F.col("is_federal_holiday"), F.lit(False))
    city = F.when(~is_holiday, F.col("nyc_event"))

    def entry(name: Column, category: Column, source: int) -> Column:
        return F.struct(name.alias("event_name"), category.alias("event_category"),
                        F.lit(source).alias("source_"))

    entries = F.array(
        entry(F.col("holiday_name"), F.lit("Federal holiday"), 1),
        entry(city, category_from_name(city), 2),
    )
    return (
        context.select(F.col(day).alias("date"), F.inline(entries))
        .filter("event_name IS NOT NULL")
        .select("date", "event_name", "event_category", nothing.alias("venue"),
                nothing.alias("borough"), "source_")
    )


def latest_event(rows: DataFrame) -> DataFrame:
    """Keep-last de-duplication; ``source_`` (and ``row_`` if given) is the order."""
    same = Window.partitionBy("date", F.lower(strip(F.col("event_name"))), "event_category")
    order = ["source_"] + [c for c in ("row_",) if c in rows.columns]
    last = same.orderBy(
        *[F.desc(c) for c in [*order, "event_name"]],
        F.desc_nulls_last("venue"),
        F.desc_nulls_last("borough"),
    )
    return (
        rows.withColumn("rank_", F.row_number().over(last))
        .filter("rank_ = 1")
        .drop("rank_", *order)
    )


def category_counts(events: DataFrame) -> DataFrame:
    """Events per category with the category's place in the display order."""
    place = rank_in(F.col("event_category"), CATEGORY_ORDER)
    return (
        events.groupBy("event_category")
        .agg(F.count(F.lit(1)).alias("events"))
        .withColumn("listed_", place)
    )


def ordered_categories(events: DataFrame) -> DataFrame:
    """Distinct categories, listed ones first in order, then the rest by name."""
    counted = category_counts(events)
    order = Window.orderBy(F.asc_nulls_last("listed_"), "event_category")
    return counted.select(
        "event_category", "events", F.row_number().over(order).alias("position")
    )


def events_in_scope(
    events: DataFrame, start, end, categories: Sequence[str] | None = None,
    areas: Sequence[str] | None = None,
) -> DataFrame:
    """Events of the chosen categories, days and areas (or with no single area)."""
    kept = events.filter(F.col("date").between(start, end))
    if categories is not None:
        kept = kept.filter(F.col("event_category").isin(*categories))
    if areas is not None:
        place = F.col("borough")
        kept = kept.filter(place.isNull() | place.isin(*areas, EVERYWHERE, ""))
    return kept


def area_daily(df: DataFrame) -> DataFrame:
    """Trips per day and area (areas that are null are left out)."""
    return (
        df.dropna(subset=["pickup_date", "borough"])
        .groupBy("pickup_date", "borough")
        .agg(F.sum("trips").alias("trips"))
    )


def demand_series(by_area: DataFrame, areas: Sequence[str] = CORE_AREAS) -> DataFrame:
    """(series, date, trips, total): one series per listed area and 'ALL'.

    ``by_area`` is any rollup with a day and an area. One aggregation per day with
    a sum per listed area, then unfolded; an area without rows on a day has no
    entry there. Rows without an area have no series of their own but count in 'ALL'
    and the total, and so in the control of every area. A rollup without areas is one
    series 'ALL' of all its rows.
    """
    if "borough" not in by_area.columns:
        total = by_area.dropna(subset=["pickup_date"]).groupBy(
            F.col("pickup_date").alias("date")
        ).agg(F.sum("trips").alias("trips"))
        return total.select("date", F.col("trips").alias("total"), F.lit(ALL).alias("series"), "trips")
    by_area = by_area.dropna(subset=["pickup_date"])
    sums = [F.sum(F.when(F.col("borough") == a, F.col("trips"))) for a in areas]
    wide = by_area.groupBy(F.col("pickup_date").alias("date")).agg(
        F.sum("trips").alias("total"), F.array(*sums).alias("parts")
    )
    names = F.array(*[F.lit(x) for x in (*areas, ALL)])
    values = F.concat("parts", F.array("total"))
    pairs = F.arrays_zip(names.alias("series"), values.alias("trips"))
    return wide.select("date", "total", F.inline(pairs)).filter("trips IS NOT NULL")


def with_series(events: DataFrame, series: DataFrame) -> DataFrame:
    """The series an event is measured on: its area if it has data, else 'ALL'."""
    present = series.agg(F.collect_set("series")).scalar()
    known = F.when(F.array_contains(present, F.col("borough")), F.col("borough"))
    return events.withColumn("series", F.coalesce(known, F.lit(ALL)))


def nearby_days(event_days: DataFrame, half_width: int) -> DataFrame:
    """Days of the same weekday within +/- N days of each (series, event_date).

    Those are exactly the days a whole number of weeks away, so a range join
    becomes a short generated list (the event day included) and an equality join.
    """
    reach = 7 * (half_width // 7)
    days = F.expr(f"sequence(date_sub(event_date, {reach}), date_add(event_date, {reach}), "
                  "interval 7 days)")
    return event_days.select("series", "event_date", F.explode(days).alias("date"))


def baseline_days(event_days: DataFrame, exclusions: DataFrame, half_width: int) -> DataFrame:
    """Nearby days that carry no event of the full calendar."""
    return nearby_days(event_days, half_width).join(
        exclusions.select("date"), "date", "left_anti"
    )


def with_baselines(series: DataFrame, exclusions: DataFrame, half_width: int) -> DataFrame:
    """Each day of a series with the means of its nearby days that carry no event.

    Nearby days are those of the same weekday within +/- N days, which are a whole number
    of weeks away: a frame of weeks within (series, weekday). One window over day rows
    gives the baseline of every day, however many events fall on it.
    """
    free = series.join(
        exclusions.select("date", F.lit(True).alias("taken")).distinct(), "date", "left")
    week = F.expr("div(date_diff(date, DATE'1899-12-31') - 1 - weekday(date), 7)")
    rows = free.withColumn("weekday_", F.weekday("date")).withColumn("week_", week)
    reach = half_width // 7
    near = Window.partitionBy("series", "weekday_").orderBy("week_").rangeBetween(-reach, reach)
    trips = F.when(F.col("taken").isNull(), F.col("trips"))
    rest = F.when(F.col("taken").isNull(), F.col("total") - F.col("trips"))
    return rows.select(
        "series", "date", "trips", (F.col("total") - F.col("trips")).alias("control_trips"),
        F.avg(trips).over(near).alias("baseline_trips"), F.avg(rest).over(near).alias("control_baseline"),
        F.count(trips).over(near).alias("baseline_days"),
    )


def event_impact(
    by_area: DataFrame,
    events: DataFrame,
    exclusions: DataFrame | None = None,
    half_width: int = 42,
    areas: Sequence[str] = CORE_AREAS,
) -> DataFrame:
    """Event-day trips against nearby same-weekday days without events.

    ``control_lift`` is the same measure for the rest of the city and ``did_lift``
    the difference; both are null for events measured on the whole city. Baselines
    are a window over the days of each series, so an event is one look-up.
    """
    series = demand_series(by_area, areas)
    placed = with_series(events, series)
    sums = with_baselines(series, events if exclusions is None else exclusions, half_width)
    lift = F.when(
        F.col("baseline_trips") > 0, F.col("trips") / F.col("baseline_trips") - 1
    )
    control = F.when(
        (F.col("series") != ALL) & (F.col("control_baseline") > 0),
        F.col("control_trips") / F.col("control_baseline") - 1,
    )
    impact = sums.select(
        "series",
        "date",
        "trips",
        "baseline_trips",
        lift.alias("lift"),
        control.alias("control_lift"),
        (lift - control).alias("did_lift"),
        "baseline_days",
    )
    return placed.join(impact, ["series", "date"]).select(
        "date", "event_name", "event_category", "venue", "borough", "series", "trips",
        "baseline_trips", "lift", "control_lift", "did_lift", "baseline_days",
    )


def event_summary(impacts: DataFrame, method: str = "did") -> DataFrame:
    """Means per category; the plotted lift falls back to the raw one under DiD."""
    rows = impacts.groupBy("event_category").agg(
        F.count("event_name").alias("events"),
        F.avg("trips").alias("avg_trips"),
        F.avg("baseline_trips").alias("avg_baseline"),
        F.avg("lift").alias("avg_lift"),
        F.avg("did_lift").alias("avg_did_lift"),
    )
    plot = F.coalesce("avg_did_lift", "avg_lift") if method == "did" else F.col("avg_lift")
    return rows.withColumns(
        {
            "did_available": F.col("avg_did_lift").isNotNull(),
            "plot_lift": plot,
            "direction": F.when(plot >= 0, "Higher than baseline").otherwise(
                "Lower than baseline"
            ),
        }
    )
