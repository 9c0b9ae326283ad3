"""Calendar parts, period starts and period labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
PERIOD_UNITS = {"week": "WEEK", "month": "MM", "year": "YEAR"}
PERIOD_FORMATS = {
    "day": "MMM dd, yyyy",
    "week": "MMM dd, yyyy",
    "month": "MMM yyyy",
    "year": "yyyy",
}


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def weekday_name(day: Column) -> Column:
    return weekday_label(F.weekday(day))


def weekday_label(number: Column) -> Column:
    """Name of a weekday number (0 = Monday); an array lookup, no formatter."""
    return F.array(*[F.lit(d) for d in WEEKDAYS])[number]


def with_time_parts(df: DataFrame, ts: str = "pickup_datetime") -> DataFrame:
    """Date, month label, weekday name, weekday number (0 = Monday) and hour."""
    day = F.to_date(F.col(ts))
    return df.withColumns(
        {
            "pickup_date": day,
            "pickup_month": month_label(day),
            "weekday": weekday_name(day),
            "weekday_num": F.weekday(day),
            "hour": F.hour(F.col(ts)),
        }
    )


def month_from_file_name(pattern: str = r"(\d{4}-\d{2})") -> Column:
    """Month label carried by the file a row was read from."""
    found = F.regexp_extract(F.col("_metadata.file_name"), pattern, 1)
    return F.when(found != "", found)


def period_start(day: Column, grain: str) -> Column:
    """First day of the week (Monday), month or year; ``day`` is unchanged."""
    return day if grain == "day" else F.trunc(day, PERIOD_UNITS[grain])


def period_label(start: Column, grain: str) -> Column:
    text = F.date_format(start, PERIOD_FORMATS[grain])
    return F.concat(F.lit("Week of "), text) if grain == "week" else text


def window_label(start: Column, end: Column) -> Column:
    text = PERIOD_FORMATS["day"]
    return F.concat_ws(" - ", F.date_format(start, text), F.date_format(end, text))
