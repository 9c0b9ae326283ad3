"""Column helpers on literal rows."""

from __future__ import annotations

import datetime as dt

from pandas.tseries.holiday import USFederalHolidayCalendar
from pyspark.sql import functions as F

from kerbflow.functions import categories, cleaning, hexcells, timeparts
from kerbflow.operators.context import federal_holidays


def values(df):
    return [tuple(r) for r in df.collect()]


def test_clean_count(spark):
    df = spark.createDataFrame(
        [("1,234",), (" 5 ",), ("abc",), (None,), ("7.9",), ("1d",), ("nan",), ("\t12\n",)],
        "c string",
    )
    got = [r[0] for r in df.select(cleaning.clean_count(F.col("c"))).collect()]
    assert got == [1234, 5, 0, 0, 7, 0, 0, 12]


def test_lenient_casts(spark):
    df = spark.createDataFrame([("2024-02-30",), ("2024-02-29 05:06:07",), ("x",), (None,)], "c string")
    got = values(df.select(cleaning.to_time(F.col("c")), cleaning.to_day(F.col("c"))))
    assert got == [
        (None, None), (dt.datetime(2024, 2, 29, 5, 6, 7), dt.date(2024, 2, 29)),
        (None, None), (None, None),
    ]


def test_codes_lookup_and_flags(spark):
    df = spark.createDataFrame([(" b1 ", "Y"), ("b2", "N"), (None, None)], "c string, f string")
    code = cleaning.clean_code(F.col("c"))
    got = values(df.select(code, cleaning.lookup(code, {"B1": "One"}), cleaning.is_yes(F.col("f"))))
    assert got == [("B1", "One", True), ("B2", "Unknown", False), (None, "Unknown", False)]


def test_null_strings(spark):
    df = spark.createDataFrame([("N/A", 1), ("", 2), ("Queens", 3)], "c string, n int")
    got = values(cleaning.nulls_from_text(df))
    assert got == [(None, 1), (None, 2), ("Queens", 3)]


def test_time_parts_and_periods(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 3, 23, 59),)], "pickup_datetime timestamp_ntz")
    row = timeparts.with_time_parts(df).first()
    assert (row.pickup_date, row.pickup_month) == (dt.date(2024, 3, 3), "2024-03")
    assert (row.weekday, row.weekday_num, row.hour) == ("Sunday", 6, 23)
    day = F.lit(dt.date(2024, 3, 3))
    got = df.select(
        *[timeparts.period_start(day, g) for g in ("day", "week", "month", "year")],
        timeparts.period_label(timeparts.period_start(day, "week"), "week"),
        timeparts.period_label(day, "month"),
        timeparts.period_label(day, "year"),
    ).first()
    assert list(got) == [
        dt.date(2024, 3, 3), dt.date(2024, 2, 26), dt.date(2024, 3, 1), dt.date(2024, 1, 1),
        "Week of Feb 26, 2024", "Mar 2024", "2024",
    ]


def test_event_categories(spark):
    df = spark.createDataFrame(
        [("Concert",), (" Parade ",), ("",), ("  ",), (None,), ("Chess",)], "c string"
    )
    got = [r[0] for r in df.select(categories.event_category(F.col("c"))).collect()]
    assert got == [
        "Concerts & music festivals", "Parades & civic festivals", "Other event", "Other event",
        "Other event", "Chess",
    ]


def test_category_from_name(spark):
    names = ["Summer OPEN", "Half Day", "Pride March", "Opening Parade", "Charity Ball", "Fair", None]
    df = spark.createDataFrame([(n,) for n in names], "c string")
    got = [r[0] for r in df.select(categories.category_from_name(F.col("c"))).collect()]
    assert got == [
        "Sports", "Sports", "Parades & civic festivals", "Sports", "Concerts & music festivals",
        "Civic / city event", "Civic / city event",
    ]


def test_direction(spark):
    df = spark.createDataFrame([(1,), (-1,), (0,), (None,)], "d int")
    got = [r[0] for r in df.select(categories.direction(F.col("d"))).collect()]
    assert got == ["Positive", "Negative", "Flat", "Flat"]


def test_federal_holidays_follow_the_public_calendar(spark):
    span = spark.createDataFrame([(dt.date(1984, 1, 1), dt.date(2040, 12, 31))], "lo date, hi date")
    got = {(r.date, r.holiday_name) for r in federal_holidays(span).collect()}
    want = {
        (day.date(), rule.name)
        for rule in USFederalHolidayCalendar().rules
        for day in rule.dates("1984-01-01", "2040-12-31")
    }
    assert got == want


def test_hex_cell_is_the_nearest_centre(spark):
    radius = 180.0
    rows = [(float(x), float(y)) for x in range(-700, 701, 93) for y in range(-700, 701, 71)]
    df = spark.createDataFrame(rows, "x double, y double")
    q, r = hexcells.hex_axial(F.col("x"), F.col("y"), radius)
    cells = df.select("x", "y", q.alias("q"), r.alias("r")).collect()

    def distance(x, y, a, b):
        cx, cy = radius * 3**0.5 * (a + b / 2), radius * 1.5 * b
        return (x - cx) ** 2 + (y - cy) ** 2

    for c in cells:
        own = distance(c.x, c.y, c.q, c.r)
        around = [(1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)]
        assert all(own <= distance(c.x, c.y, c.q + i, c.r + j) + 1e-6 for i, j in around)
