"""Build of the unified tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from kerbflow.operators import unify
from kerbflow.operators.unify import Source
from kerbflow.sources.sinks import manifest, write_parquet

BUILDERS = {
    "unified_daily_by_company": unify.daily_by_company,
    "unified_daily_by_borough": unify.daily_by_borough,
    "unified_daily_by_zone": unify.daily_by_zone,
    "unified_hourly_by_company": unify.hourly_by_company,
}


def build_unified(
    spark: SparkSession, sources: Mapping[str, Sequence[Source]], out: str, **options
) -> DataFrame:
    """Write each unified table and the annual summary; returns the manifest.

    ``sources`` maps a table name to its source rollups. Later steps read the
    written tables instead of planning the merge again.
    """
    tables = {}
    for name, members in sources.items():
        write_parquet(BUILDERS[name](members, **options), f"{out}/{name}")
        tables[name] = spark.read.parquet(f"{out}/{name}")
    if "unified_daily_by_company" in tables:
        annual = unify.annual_summary(tables["unified_daily_by_company"])
        write_parquet(annual, f"{out}/unified_annual_summary")
        tables["unified_annual_summary"] = spark.read.parquet(f"{out}/unified_annual_summary")
    return manifest(tables)
