"""Raw trip records of each source to the trip model.

Every function is one projection and one filter over plain columns, so column
pruning and the code filter reach the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbflow.functions import cleaning as clean
from kerbflow.functions.timeparts import month_from_file_name, month_label
from kerbflow.operators.rollup import FLAGS, MEASURES

# Dispatch bases and their names.
BASE_NAMES = {
    "B02512": "Unter",
    "B02598": "Hinter",
    "B02617": "Weiter",
    "B02682": "Schmecken",
    "B02764": "Danach-NY",
    "B02765": "Grun",
    "B02835": "Dreist",
    "B02836": "Drinnen",
}


def _or_null(df: DataFrame, name: str, kind: str) -> Column:
    present = name.lower() in {c.lower() for c in df.columns}
    return F.col(name) if present else F.lit(None).cast(kind)


def high_volume_trips(
    raw: DataFrame, licenses: Sequence[str], companies: Mapping[str, str],
    month: str | None = None, month_from_file: bool = False,
) -> DataFrame:
    """Trips of the chosen licences; a trip without time or location is dropped.

    ``month`` labels all rows with their file's month instead of the trip's own;
    ``month_from_file`` takes it from each row's file name.
    """
    kept = raw.filter(F.col("hvfhs_license_num").isin(*licenses))
    sums = [
        F.col(c).try_cast("double" if c != "trip_time" else "bigint").alias(c)
        for c in MEASURES
        if c in raw.columns
    ]
    flags = [clean.is_yes(_or_null(raw, c, "string")).alias(c) for c in FLAGS]
    time = clean.to_time(F.col("pickup_datetime"))
    label = _label(time, month, month_from_file)
    return kept.select(
        "hvfhs_license_num",
        clean.lookup(F.col("hvfhs_license_num"), companies).alias("company"),
        time.alias("pickup_datetime"),
        label.alias("pickup_month"),
        F.col("PULocationID").try_cast("double").cast("bigint").alias("location_id"),
        *sums,
        *flags,
    ).dropna(subset=["pickup_datetime", "location_id"])


def base_trips(
    raw: DataFrame, company: str, bases: Mapping[str, str] = BASE_NAMES,
    month: str | None = None, month_from_file: bool = False,
) -> DataFrame:
    """Trips of the listed bases (exact codes); a missing location is kept."""
    base = F.coalesce("dispatching_base_num", F.lit(""))
    time = clean.to_time(F.col("pickup_datetime"))
    place = _or_null(raw, "PULocationID", "double").try_cast("double")
    return (
        raw.filter(base.isin(*bases))
        .select(
            base.alias("base"),
            clean.lookup(base, bases).alias("base_name"),
            F.lit(company).alias("company"),
            time.alias("pickup_datetime"),
            _label(time, month, month_from_file).alias("pickup_month"),
            place.cast("bigint").alias("location_id"),
        )
        .dropna(subset=["pickup_datetime"])
    )


def _label(time: Column, month: str | None, from_file: bool) -> Column:
    if month is not None:
        return F.lit(month)
    return month_from_file_name() if from_file else month_label(time.cast("date"))


def gps_trips(raw: DataFrame, bases: Mapping[str, str] = BASE_NAMES) -> DataFrame:
    """Point records: time, coordinates and base are all required."""
    base = F.upper("Base")
    return raw.select(
        F.coalesce(
            F.try_to_timestamp("Date/Time", F.lit("M/d/yyyy H:mm:ss")),
            F.try_to_timestamp("Date/Time"),
        ).cast("timestamp_ntz").alias("pickup_datetime"),
        F.col("Lat").alias("lat"),
        F.col("Lon").alias("lon"),
        base.alias("base"),
        clean.lookup(base, bases).alias("base_name"),
    ).dropna(subset=["pickup_datetime", "lat", "lon", "base"])


def dispatch_trips(raw: DataFrame) -> DataFrame:
    """Records with dispatching and affiliated base and a required location."""
    return raw.select(
        clean.to_time(F.col("Pickup_date")).alias("pickup_datetime"),
        F.upper("Dispatching_base_num").alias("dispatching_base"),
        F.upper("Affiliated_base_num").alias("affiliated_base"),
        F.col("locationID").cast("bigint").alias("location_id"),
    ).dropna(subset=["pickup_datetime", "location_id"])


def _month_day(c: Column) -> Column:
    return F.coalesce(clean.to_day(c), F.try_to_timestamp(c, F.lit("M/d/yyyy")).cast("date"))


def base_supply(raw: DataFrame, bases: Mapping[str, str] = BASE_NAMES) -> DataFrame:
    """Daily trips and active vehicles of each base."""
    day, base = _month_day(F.col("date")), F.upper("dispatching_base_number")
    return raw.select(
        day.alias("pickup_date"),
        month_label(day).alias("pickup_month"),
        base.alias("dispatching_base"),
        clean.lookup(base, bases).alias("base_name"),
        clean.clean_count(F.col("active_vehicles")).alias("active_vehicles"),
        clean.clean_count(F.col("trips")).alias("trips"),
    )


def operator_supply(raw: DataFrame) -> DataFrame:
    """Daily trips and vehicles of every operator (columns already renamed)."""
    day = _month_day(F.col("pickup_date"))
    return raw.dropna(subset=["base", "pickup_date"]).select(
        day.alias("pickup_date"),
        month_label(day).alias("pickup_month"),
        clean.clean_code(F.col("base")).alias("base"),
        clean.strip(F.col("base_name")).alias("base_name"),
        clean.clean_count(F.col("trips")).alias("trips"),
        clean.clean_count(F.col("vehicles")).alias("vehicles"),
    )


def day_place_counts(rows: DataFrame, zones: DataFrame, company: str, month: str) -> DataFrame:
    """Pre-aggregated (day, location) rows of a service, all columns text."""
    counts = rows.select(
        clean.to_day(F.col("pickup_day")).alias("pickup_date"),
        F.lit(month).alias("pickup_month"),
        F.lit(company).alias("company"),
        clean.to_number(F.col("location_id")).cast("bigint").alias("location_id"),
        clean.clean_count(F.col("trips")).alias("trips"),
    )
    named = counts.join(zones.select("location_id", "borough", "zone"), "location_id", "left")
    return named.fillna("Unknown", ["borough", "zone"])


def day_hour_counts(rows: DataFrame, company: str, month: str) -> DataFrame:
    """Pre-aggregated (day, hour) rows; an unreadable hour counts as hour 0."""
    return rows.select(
        clean.to_day(F.col("pickup_day")).alias("pickup_date"),
        F.lit(month).alias("pickup_month"),
        clean.clean_count(F.col("hour")).cast("int").alias("hour"),
        F.lit(company).alias("company"),
        clean.clean_count(F.col("trips")).alias("trips"),
    )


def zone_dimension(raw: DataFrame) -> DataFrame:
    """Zone lookup under the model's names; ``N/A`` and blanks are null."""
    renamed = raw.withColumnsRenamed(
        {"LocationID": "location_id", "Borough": "borough", "Zone": "zone"}
    )
    return clean.nulls_from_text(renamed, ["borough", "zone"]).withColumn(
        "location_id", F.col("location_id").try_cast("bigint")
    )
