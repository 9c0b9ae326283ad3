"""Period and group selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Areas named by the borough presets.
CORE_AREAS = ("Bronx", "Brooklyn", "Manhattan", "Queens", "Staten Island")
MAIN_AREA = "Manhattan"
SOURCE_CHANGE = "2019-02-01"


def in_period(df: DataFrame, start, end, day: str = "pickup_date") -> DataFrame:
    """Both ends included."""
    return df.filter(F.col(day).between(_day(start), _day(end)))


def _day(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def preset_ranges(daily: DataFrame, today, change: str = SOURCE_CHANGE) -> DataFrame:
    """One row per date-range preset: preset, start_date, end_date."""
    end = F.least(F.col("b.hi"), _day(today))
    starts = {
        "1D": end,
        "7D": F.date_sub(end, 6),
        "30D": F.date_sub(end, 29),
        "90D": F.date_sub(end, 89),
        "MTD": F.trunc(end, "MM"),
        "YTD": F.trunc(end, "YEAR"),
        "1Y": F.date_sub(end, 364),
        "5Y": F.date_sub(end, 365 * 5 - 1),
        "All": F.col("b.lo"),
        "Post-2019": _day(change),
    }
    bounds = daily.agg(
        F.struct(F.min("pickup_date").alias("lo"), F.max("pickup_date").alias("hi")).alias("b")
    )
    rows = F.array(
        *[F.struct(F.lit(n).alias("preset"), s.alias("start")) for n, s in starts.items()]
    )
    offered = (F.col("b.lo") < _day(change)) & (_day(change) <= F.col("b.hi"))
    return (
        bounds.select("b", F.explode(rows).alias("p"))
        .filter((F.col("p.preset") != "Post-2019") | offered)
        .select(
            F.col("p.preset").alias("preset"),
            F.greatest(F.col("b.lo"), F.col("p.start")).alias("start_date"),
            end.alias("end_date"),
        )
    )


def preset_start(daily: DataFrame, preset: str, today) -> tuple[Column, Column]:
    """Start and end of one preset as scalar columns for ``in_period``."""
    chosen = preset_ranges(daily, today).filter(F.col("preset") == preset)
    bounds = chosen.select(F.struct("start_date", "end_date").alias("b")).scalar()
    return bounds["start_date"], bounds["end_date"]


def group_volumes(df: DataFrame, group: str, value: str = "trips") -> DataFrame:
    """Selectable groups: non-null values as text with their volume."""
    return (
        df.dropna(subset=[group])
        .groupBy(F.col(group).cast("string").alias(group))
        .agg(F.sum(value).alias(value))
    )


def top_groups(df: DataFrame, group: str | Sequence[str], n: int = 12,
               value: str = "trips") -> DataFrame:
    """The n largest groups by volume; ties go to the lower name."""
    keys = [group] if isinstance(group, str) else list(group)
    return (
        df.dropna(subset=keys)
        .groupBy(*keys)
        .agg(F.sum(value).alias(value))
        .orderBy(F.desc(value), *keys)
        .limit(n)
    )


def select_groups(
    df: DataFrame,
    group: str,
    preset: str = "all",
    custom: Sequence[str] = (),
    core: Sequence[str] = CORE_AREAS,
    main: str = MAIN_AREA,
) -> DataFrame:
    """Rows of the chosen groups: all, core, main, outer, top3, top5 or custom.

    Rows without a group fall out under every preset, as they are not selectable.
    """
    name = F.col(group).cast("string")
    if preset == "all":
        return df.filter(name.isNotNull())
    if preset in ("top3", "top5"):
        best = top_groups(df, group, int(preset[3:])).select(group)
        return df.join(best, group, "left_semi")
    chosen = {
        "core": list(core),
        "main": [main],
        "outer": [a for a in core if a != main],
        "custom": list(custom),
    }[preset]
    return df.filter(name.isin(chosen))


def area_share(df: DataFrame, area: str = "borough") -> DataFrame:
    """Volume per area and its share of the total."""
    areas = df.dropna(subset=[area]).groupBy(area).agg(F.sum("trips").alias("trips"))
    total = areas.agg(F.sum("trips")).scalar()
    return areas.withColumn("share", F.col("trips") / total)
