"""Daily series: totals, gaps, resampling, growth and period comparison.

Inputs are rollups. After the first grouping a frame has one row per day (and
series), so an ordered window over a whole series holds as many rows as the
calendar has days, however large the trips behind it are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.functions.timeparts import month_label, period_label, period_start

DATE = "pickup_date"


def daily_total(df: DataFrame, by: Sequence[str] = (), value: str = "trips") -> DataFrame:
    """Sum per day (and series); rows without a date or series are left out."""
    keys = [*by, DATE]
    return df.dropna(subset=keys).groupBy(*keys).agg(F.sum(value).alias(value))


def day_bounds(daily: DataFrame, value: str = "trips") -> Column:
    """Scalar struct (lo, hi) of the first and last day."""
    lo, hi = _edge(F.min, value), _edge(F.max, value)
    return daily.agg(F.struct(lo.alias("lo"), hi.alias("hi")).alias("b")).scalar()


def _series_window(by: Sequence[str]):
    window = Window.partitionBy(*by) if by else Window
    return window.orderBy(DATE)


def fill_days(daily: DataFrame, by: Sequence[str] = (), value: str = "trips") -> DataFrame:
    """Zero-filled series: each observed day also yields the gap that follows it.

    One ordered pass per series; no date spine and no join.
    """
    following = F.date_sub(F.lead(DATE).over(_series_window(by)), 1)
    runs = daily.select(*by, DATE, value, following.alias("until"))
    run = F.sequence(F.col(DATE), F.coalesce("until", DATE))
    return runs.select(*by, value, F.posexplode(run).alias("gap", DATE)).select(
        *by, DATE, F.when(F.col("gap") == 0, F.col(value)).otherwise(0).alias(value)
    )


def _edge(side, value: str = "trips") -> Column:
    """First or last day by ``F.min`` / ``F.max``.

    The value rides along so that the aggregate needs the same columns as the
    rollup below it and reuses its exchange; the day alone would be read by a
    second scan of the trips.
    """
    return side(F.struct(DATE, value))[DATE]


def day_range(daily: DataFrame) -> DataFrame:
    """One row (lo, hi): first and last day."""
    return daily.agg(_edge(F.min).alias("lo"), _edge(F.max).alias("hi"))


def date_spine(ranges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every calendar day of each (lo, hi) row."""
    return ranges.select(*by, F.explode(F.sequence("lo", "hi")).alias(DATE))


def missing_dates(daily: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Calendar days of the range (default: that of the data) that carry no row."""
    spine = date_spine(day_range(daily) if ranges is None else ranges)
    days = daily.dropna(subset=[DATE]).select(DATE)
    return spine.join(days, DATE, "left_anti")


def kpis(df: DataFrame) -> DataFrame:
    """Total, mean per day, and the peak day (the first one on ties)."""
    earliest_peak = F.max_by(DATE, F.struct("trips", -F.unix_date(DATE)))
    return daily_total(df).agg(
        F.sum("trips").alias("total_trips"),
        F.avg("trips").alias("avg_daily"),
        earliest_peak.alias("peak_day"),
        F.max("trips").alias("peak_trips"),
    )


def resample(df: DataFrame, grain: str, value: str = "trips",
             by: Sequence[str] = ()) -> DataFrame:
    """Sum per day, week (Monday), month or year with a readable label."""
    start = period_start(F.col(DATE), grain)
    out = (
        df.dropna(subset=[DATE, *by])
        .groupBy(*by, start.alias(DATE))
        .agg(F.sum(value).alias(value))
    )
    if grain == "day":
        return out
    return out.withColumn("period_label", period_label(F.col(DATE), grain))


def rolling_mean(df: DataFrame, rows: int = 7, by: Sequence[str] = ()) -> DataFrame:
    """Mean over the last ``rows`` observed days (rows, not calendar days)."""
    frame = _series_window(by).rowsBetween(1 - rows, 0)
    return daily_total(df, by).withColumn(f"rolling_{rows}d", F.avg("trips").over(frame))


def month_growth(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Month totals and their change on the previous observed month."""
    label = F.col("pickup_month") if "pickup_month" in df.columns else month_label(F.col(DATE))
    months = (
        df.withColumn("pickup_month", label)
        .dropna(subset=["pickup_month", *by])
        .groupBy(*by, "pickup_month")
        .agg(F.sum("trips").alias("trips"))
    )
    order = (Window.partitionBy(*by) if by else Window).orderBy("pickup_month")
    before = F.lag("trips").over(order)
    growth = F.col("trips") / F.nullif(before, F.lit(0)) - 1
    return months.withColumn("mom_growth", growth)


def _change(current: Column, prior: Column) -> Column:
    return (current - prior) / F.nullif(prior, F.lit(0))


def weekly_delta(df: DataFrame) -> DataFrame:
    """Last 7 against the 7 observed days before; null below 14 days or on 0."""
    last = daily_total(df).orderBy(F.desc(DATE)).limit(14)
    ranked = last.withColumn("n", F.row_number().over(Window.orderBy(F.desc(DATE))))
    current = F.sum(F.when(F.col("n") <= 7, F.col("trips")))
    prior = F.sum(F.when(F.col("n") > 7, F.col("trips")))
    enough = F.count(F.lit(1)) == 14
    return ranked.agg(
        F.when(enough, current / F.nullif(prior, F.lit(0)) - 1).alias("weekly_delta")
    )


GROWTH_SPANS = {"dod": 1, "wow": 7, "mom": 30, "yoy": 365}


def growth_stats(df: DataFrame) -> DataFrame:
    """Trailing windows of 1, 7, 30 and 365 days against the window before."""
    daily = daily_total(df)
    aged = daily.select("trips", F.date_diff(day_bounds(daily)["hi"], DATE).alias("age"))

    def total(first: int, last: int) -> Column:
        inside = F.when(F.col("age").between(first, last), F.col("trips"))
        return F.coalesce(F.sum(inside), F.lit(0))

    return aged.agg(
        *[
            _change(total(0, n - 1), total(n, 2 * n - 1)).alias(name)
            for name, n in GROWTH_SPANS.items()
        ]
    )


def comparison_windows(daily: DataFrame, period: str, mode: str) -> DataFrame:
    """One row with the bounds of the running period and of the one compared with.

    ``mode`` is ``previous`` (same number of days from the start of the period
    before) or ``last_year`` (the same dates one year earlier).
    """
    hi, lo = F.col("current_end"), F.col("current_start")
    other_lo, other_hi = F.col("comparison_start"), F.col("comparison_end")
    step = {"week": F.date_sub(lo, 7), "month": F.add_months(lo, -1), "year": F.add_months(lo, -12)}
    last_year = mode == "last_year"
    return (
        daily.agg(_edge(F.max).alias("current_end"))
        .select(hi, period_start(hi, period).alias("current_start"))
        .select(hi, lo, (F.add_months(lo, -12) if last_year else step[period]).alias(
            "comparison_start"))
        .select(hi, lo, other_lo, (
            F.add_months(hi, -12) if last_year else F.date_add(other_lo, F.date_diff(hi, lo))
        ).alias("comparison_end"))
    )


def compare_periods(df: DataFrame, period: str, mode: str) -> DataFrame:
    """Day-by-day rows of both windows, aligned on the current axis.

    ``plot_date`` is null where the other window is longer than the current one.
    """
    return _compared_days(daily_total(df), period, mode).select(
        "period", "day", DATE, "plot_date", "trips"
    )


def _compared_days(daily: DataFrame, period: str, mode: str) -> DataFrame:
    """Days of both windows with their trips; the window bounds ride along."""
    windows = comparison_windows(daily, period, mode)
    axes = F.array(
        F.struct(F.lit("current").alias("period"),
                 F.sequence("current_start", "current_end").alias("days")),
        F.struct(F.lit(mode).alias("period"),
                 F.sequence("comparison_start", "comparison_end").alias("days")),
    )
    days = windows.select("*", F.inline(axes)).select(
        *windows.columns, "period", F.posexplode("days").alias("pos", DATE)
    )
    plotted = F.date_add("current_start", F.col("pos"))
    return days.join(daily, DATE, "left").select(
        *windows.columns,
        "period",
        (F.col("pos") + 1).alias("day"),
        DATE,
        F.when(plotted <= F.col("current_end"), plotted).alias("plot_date"),
        F.coalesce("trips", F.lit(0)).alias("trips"),
    )


def comparison_totals(df: DataFrame, period: str, mode: str) -> DataFrame:
    """Totals of both windows and the relative change (null on a zero total)."""
    current = F.coalesce(F.sum(F.when(F.col("period") == "current", F.col("trips"))), F.lit(0))
    other = F.coalesce(F.sum(F.when(F.col("period") == mode, F.col("trips"))), F.lit(0))
    bounds = ["current_start", "current_end", "comparison_start", "comparison_end"]
    return _compared_days(daily_total(df), period, mode).groupBy(*bounds).agg(
        current.alias("current_total"),
        other.alias("comparison_total"),
        (current / F.nullif(other, F.lit(0)) - 1).alias("delta"),
    )


def union_dates(*frames: DataFrame) -> DataFrame:
    """Distinct days that occur in any of the frames."""
    out = frames[0].select(DATE)
    for frame in frames[1:]:
        out = out.union(frame.select(DATE))
    return out.distinct()
