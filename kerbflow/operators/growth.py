"""Ranked gains and losses of groups between two adjacent windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbflow.functions.categories import direction
from kerbflow.functions.timeparts import window_label
from kerbflow.operators.selection import exact_quantile
from kerbflow.operators.series import day_bounds
from kerbflow.session import shared_folder

# Comparison horizons in months.
HORIZONS = {
    "Last month": 1,
    "Last 6 months": 6,
    "Last 1 year": 12,
    "Last 3 years": 36,
    "Last 5 years": 60,
}
RANKINGS = ("largest_gains", "largest_losses", "growth")


def horizon_months(horizon: int | str) -> int:
    """Months of a named horizon, or the number itself."""
    if isinstance(horizon, int):
        return horizon
    if horizon not in HORIZONS:
        raise ValueError(f"{horizon!r} is none of {list(HORIZONS)}")
    return HORIZONS[horizon]


def group_daily(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Trips per day and group; the shared base of windows, ranks and guards."""
    return df.dropna(subset=["pickup_date"]).groupBy("pickup_date", *group).agg(
        F.sum("trips").alias("trips")
    )


def growth_windows(bounds: DataFrame, months: int) -> DataFrame:
    """Adds both windows to rows that carry (lo, hi), the first and last day.

    The current window is the last ``months`` months, the prior one as many before.
    """
    start = F.date_add(F.add_months("hi", -months), 1)
    return bounds.withColumn("current_start", start).withColumns(
        {
            "prior_end": F.date_sub("current_start", 1),
            "prior_start": F.add_months("current_start", -months),
        }
    )


def with_windows(daily: DataFrame, months: int) -> DataFrame:
    """The daily rows beside the window bounds (one scalar subquery)."""
    bound = daily.withColumn("b_", day_bounds(daily))
    flat = bound.withColumns({"lo": F.col("b_.lo"), "hi": F.col("b_.hi")}).drop("b_")
    return growth_windows(flat, months)


def compare_groups(daily: DataFrame, group: Sequence[str], months: int) -> DataFrame:
    """Both windows per group in one aggregation (null is a group of its own).

    A group seen only in the prior window is left out; growth is null when the
    prior window is empty.
    """
    day, trips = F.col("pickup_date"), F.col("trips")
    is_current = day.between(F.col("current_start"), F.col("hi"))
    is_prior = day.between(F.col("prior_start"), F.col("prior_end"))
    sums = (
        with_windows(daily, months)
        .groupBy(*group)
        .agg(
            F.sum(F.when(is_current, trips)).alias("current_trips"),
            F.coalesce(F.sum(F.when(is_prior, trips)), F.lit(0)).alias("prior_trips"),
        )
        .filter("current_trips IS NOT NULL")
    )
    delta = F.col("current_trips") - F.col("prior_trips")
    growth = F.when(
        F.col("prior_trips") > 0, F.col("current_trips") / F.col("prior_trips") - 1
    )
    return sums.select(
        "*", delta.alias("trip_delta"), growth.alias("growth"), direction(delta).alias("direction")
    )


def coverage(daily: DataFrame, months: int) -> DataFrame:
    """One row: the windows and the calendar days in them that carry no rows."""
    bounds = ["lo", "hi", "current_start", "prior_end", "prior_start"]
    days = with_windows(daily, months)
    inside = F.when(F.col("pickup_date").between(F.col("prior_start"), F.col("hi")),
                    F.col("pickup_date"))
    expected = F.date_diff("hi", "prior_start") + 1
    present = days.groupBy(*bounds).agg(F.countDistinct(inside).alias("present"))
    return present.withColumn("missing_days", expected - F.col("present"))


def growth_opportunities(
    df: DataFrame,
    group: Sequence[str],
    months: int | str,
    top: int | None = 15,
    volume_quantile: float | None = 0.5,
    rank_by: str = "largest_gains",
    complete_days: bool = False,
    many_groups: bool = False,
) -> DataFrame:
    """Ranked groups above a volume quantile; ``months`` may name a horizon.

    When the floor leaves nothing, all groups are ranked. ``complete_days``
    empties the result if any day of the windows has no rows. The exact quantile
    is taken over one value per group, after the aggregation: for areas or zones in the
    plan, with ``many_groups`` over stored groups by distributed selection, so that no
    task has to hold the volumes of all groups.
    """
    if rank_by not in RANKINGS:
        raise ValueError(f"{rank_by!r} is none of {RANKINGS}")
    months = horizon_months(months)
    daily = group_daily(df, group)
    kept = out = compare_groups(daily, group, months)
    current, comparable = F.col("current_trips"), F.col("prior_trips") > 0
    floor = F.percentile(current, F.lit(volume_quantile or 0.0))
    if many_groups:
        path = shared_folder(df.sparkSession, "group-volumes")
        out.write.parquet(path)
        kept = out = df.sparkSession.read.schema(out.schema).parquet(path)
        if volume_quantile is not None or rank_by == "growth":
            floor = F.lit(exact_quantile(out, volume_quantile or 0.0, "current_trips")).cast("double")
    if rank_by == "growth":
        # Null when no comparable group reaches the floor: then all groups stay.
        reached = F.max(F.when(comparable, current)) >= floor
        limit = out.agg(F.when(reached, floor).alias("floor")).scalar()
        kept = out.filter(limit.isNull() | ((current >= limit) & comparable))
    elif volume_quantile is not None:
        kept = out.filter(current >= out.agg(floor.alias("floor")).scalar())
    if complete_days:
        missing = coverage(daily, months).select("missing_days").scalar()
        kept = kept.filter(missing == 0)
    order = {
        "largest_gains": [F.desc("trip_delta"), F.desc_nulls_last("growth")],
        "largest_losses": [F.asc("trip_delta"), F.asc_nulls_last("growth")],
        "growth": [F.desc_nulls_last("growth"), F.desc("trip_delta")],
    }[rank_by]
    if top is None:
        return kept
    return kept.orderBy(*order, *[F.asc_nulls_last(g) for g in group]).limit(top)


def growth_meta(df: DataFrame, group: Sequence[str], months: int) -> DataFrame:
    """Window labels, missing days and whether the data starts too late."""
    return coverage(group_daily(df, group), months).select(
        window_label(F.col("current_start"), F.col("hi")).alias("current_window"),
        window_label(F.col("prior_start"), F.col("prior_end")).alias("prior_window"),
        "missing_days",
        (F.col("lo") > F.col("prior_start")).alias("starts_late"),
    )
