"""United States federal holidays as column expressions over a year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public federal rules. A fixed-day holiday moves to the nearest
# working day; the others are the n-th weekday of a month (-1 = last).
FIXED_DAY = (
    ("New Year's Day", 1, 1, None),
    ("Juneteenth National Independence Day", 6, 19, 2021),
    ("Independence Day", 7, 4, None),
    ("Veterans Day", 11, 11, None),
    ("Christmas Day", 12, 25, None),
)
NTH_WEEKDAY = (
    ("Birthday of Martin Luther King, Jr.", 1, "MON", 3, 1986),
    ("Washington's Birthday", 2, "MON", 3, None),
    ("Memorial Day", 5, "MON", -1, None),
    ("Labor Day", 9, "MON", 1, None),
    ("Columbus Day", 10, "MON", 2, None),
    ("Thanksgiving Day", 11, "THU", 4, None),
)


def nth_weekday(year: Column, month: int, day_name: str, n: int) -> Column:
    first = F.make_date(year, F.lit(month), F.lit(1))
    if n > 0:
        return F.date_add(F.next_day(F.date_sub(first, 1), day_name), 7 * (n - 1))
    return F.date_add(F.next_day(F.last_day(first), day_name), 7 * n)


def nearest_workday(day: Column) -> Column:
    return (
        F.when(F.weekday(day) == 5, F.date_sub(day, 1))
        .when(F.weekday(day) == 6, F.date_add(day, 1))
        .otherwise(day)
    )


def holidays_of(year: Column) -> Column:
    """Array of (holiday_name, date) for one year; dates are observed dates."""

    def entry(name: str, day: Column, since: int | None) -> Column:
        when = day if since is None else F.when(year >= since, day)
        return F.struct(F.lit(name).alias("holiday_name"), when.alias("date"))

    fixed = [
        entry(n, nearest_workday(F.make_date(year, F.lit(m), F.lit(d))), s)
        for n, m, d, s in FIXED_DAY
    ]
    moving = [entry(n, nth_weekday(year, m, w, k), s) for n, m, w, k, s in NTH_WEEKDAY]
    return F.array(*fixed, *moving)
