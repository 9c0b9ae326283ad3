"""Lenient casts and code clean-up."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\v"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# The strings a pandas CSV reader treats as missing.
NULL_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def to_number(c: Column) -> Column:
    """Text to double, anything else to null (Java suffixes such as ``1d`` too)."""
    text = strip(c.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def clean_count(c: Column) -> Column:
    """``"1,234"`` -> 1234; unreadable or missing -> 0."""
    number = to_number(F.replace(c.cast("string"), F.lit(","), F.lit("")))
    return F.coalesce(number.try_cast("bigint"), F.lit(0).cast("bigint"))


def to_time(c: Column) -> Column:
    return c.try_cast("timestamp_ntz")


def to_day(c: Column) -> Column:
    return c.try_cast("timestamp_ntz").cast("date")


def clean_code(c: Column) -> Column:
    return F.upper(strip(c))


def lookup(c: Column, names: Mapping[str, str], default: str | None = "Unknown") -> Column:
    """Small literal lookup; use a dimension join for anything that can grow."""
    if not names:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), F.lit(default))


def is_yes(c: Column) -> Column:
    return c.eqNullSafe("Y")


def nulls_from_text(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Turn the usual missing-value spellings of text columns into nulls."""
    names = columns or [f.name for f in df.schema if f.dataType.typeName() == "string"]
    return df.withColumns(
        {n: F.when(~F.col(n).isin(*NULL_STRINGS), F.col(n)) for n in names}
    )
