"""Calendar and weather context, and demand by weather."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.functions.holidays import holidays_of
from kerbflow.functions.timeparts import period_start, weekday_name


def federal_holidays(ranges: DataFrame) -> DataFrame:
    """Observed federal holidays within each (lo, hi) row.

    One year either side is generated first: an observed date can fall in the
    year before its holiday.
    """
    years = ranges.select(
        "lo", "hi", F.explode(F.sequence(F.year("lo") - 1, F.year("hi") + 1)).alias("year")
    )
    named = years.select("lo", "hi", F.inline(holidays_of(F.col("year"))))
    return named.filter(F.col("date").between(F.col("lo"), F.col("hi"))).select(
        "date", "holiday_name"
    )


def calendar_features(dates: DataFrame, holidays: DataFrame, day: str = "date") -> DataFrame:
    """Calendar columns for each date; ``holidays`` is (date, holiday_name)."""
    d = F.col("date")
    base = dates.select(F.col(day).alias("date")).withColumns(
        {
            "year": F.year(d),
            "month": F.month(d),
            "month_name": F.date_format(d, "MMMM"),
            "weekday": weekday_name(d),
            "weekday_num": F.weekday(d),
            "week_start": period_start(d, "week"),
            "is_weekend": F.weekday(d) >= 5,
            "is_month_start": F.dayofmonth(d) == 1,
            "is_month_end": d == F.last_day(d),
        }
    )
    return base.join(holidays, "date", "left").withColumns(
        {
            "is_federal_holiday": F.col("holiday_name").isNotNull(),
            "nyc_event": F.lit(None).cast("string"),
            "has_nyc_event": F.lit(False),
        }
    )


def weather_features(raw: DataFrame) -> DataFrame:
    """Averages and wet-day flags of daily weather readings."""
    def mean(a: str, b: str) -> Column:
        return (F.col(a) + F.col(b)) / 2

    def wet(c: str) -> Column:
        return F.coalesce(F.col(c) > 0, F.lit(False))

    derived = {
        "has_rain": wet("rain_sum"),
        "has_snow": wet("snowfall_sum"),
        "has_precipitation": wet("precipitation_sum"),
        "temperature_avg_f": mean("temperature_2m_max", "temperature_2m_min"),
    }
    if "apparent_temperature_max" in raw.columns:
        derived["apparent_temperature_avg_f"] = mean(
            "apparent_temperature_max", "apparent_temperature_min"
        )
    return raw.withColumns(derived)


def daily_context(calendar: DataFrame, weather: DataFrame) -> DataFrame:
    return calendar.join(weather, "date", "left")


def enrich(rollup: DataFrame, context: DataFrame) -> DataFrame:
    """Left join of the context on the rollup's day (one row per date in context)."""
    days = context.withColumnRenamed("date", "pickup_date")
    shared = set(rollup.columns) & set(days.columns) - {"pickup_date"}
    return rollup.join(days.drop(*shared), "pickup_date", "left")


def daily_with_context(df: DataFrame, context: DataFrame) -> DataFrame:
    daily = df.dropna(subset=["pickup_date"]).groupBy("pickup_date").agg(
        F.sum("trips").alias("trips")
    )
    return enrich(daily, context)


def weather_lift(daily: DataFrame, wet: str = "has_precipitation") -> DataFrame:
    """Mean trips of wet days over dry days, minus 1.

    Null unless both kinds of day occur and the dry mean is not 0.
    """
    days = daily.dropna(subset=["pickup_date", wet]).groupBy("pickup_date", wet).agg(
        F.sum("trips").alias("trips")
    )
    rainy = F.avg(F.when(F.col(wet), F.col("trips")))
    dry = F.avg(F.when(~F.col(wet), F.col("trips")))
    return days.agg((rainy / F.nullif(dry, F.lit(0.0)) - 1).alias("weather_lift"))


def weather_means(daily: DataFrame, wet: str = "has_precipitation") -> DataFrame:
    label = F.when(F.col(wet), "Rain/Snow").otherwise("Dry")
    known = daily.dropna(subset=[wet])
    return known.groupBy(label.alias("weather")).agg(F.avg("trips").alias("avg_trips"))


def temperature_trend(
    daily: DataFrame, x: str = "temperature_avg_f", by: Sequence[str] = ("has_precipitation",)
) -> DataFrame:
    """Least-squares line of trips on temperature per weather class."""
    known = daily.dropna(subset=["trips", x, *by])
    y, t = F.col("trips").cast("double"), F.col(x)
    return known.groupBy(*by).agg(
        F.regr_slope(y, t).alias("slope"),
        F.regr_intercept(y, t).alias("intercept"),
        F.regr_r2(y, t).alias("r2"),
        F.count(F.lit(1)).alias("days"),
    )


def impute_climatology(
    days: DataFrame, values: Sequence[str], flags: Sequence[str] = (), day: str = "pickup_date"
) -> DataFrame:
    """Fill gaps by day-of-year mean, month mean, overall mean, then 0.

    All means come from observed values only; null flags become false. Groups are
    calendar groups of a one-row-per-day frame.
    """
    doy = Window.partitionBy(F.dayofyear(day))
    month = Window.partitionBy(F.month(day))
    means = days.agg(F.struct(*[F.avg(v).alias(v) for v in values]).alias("m")).scalar()
    filled = {
        v: F.coalesce(
            F.col(v), F.avg(v).over(doy), F.avg(v).over(month), means[v], F.lit(0.0)
        )
        for v in values
    }
    filled |= {f: F.coalesce(F.col(f), F.lit(False)) for f in flags}
    return days.withColumns(filled)
