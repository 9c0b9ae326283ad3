"""Unified and annual tables kept up to date by deltas of corrected months.

All three tables are in one snapshot store and change by one commit. A correction reads
the old shard, the other sources' rows of that month and the annual rows of that year.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbflow.functions.timeparts import month_label
from kerbflow.operators import deltas
from kerbflow.operators.unify import Source, union_sources
from kerbflow.sources.snapshots import SnapshotStore, Written

KEYS = ("pickup_date", "company")
SUMS, UNIFIED, ANNUAL = "source_sums", "unified_daily", "annual"
YEAR = ("year", "company")


def _shard(source: Source, company: str = "all") -> DataFrame:
    """A daily rollup as sums of its source: one row for each date and company."""
    rows = source.frame if "company" in source.frame.columns else source.frame.withColumn(
        "company", F.lit(company))
    rows = deltas.with_support(rows.drop("pickup_month", "source", "source_priority"), KEYS)
    rows = deltas.added([rows], KEYS)
    return rows.withColumns({
        "source": F.lit(source.name), "source_priority": F.lit(source.priority),
        "pickup_month": month_label(F.col("pickup_date"))})


def build(store: SnapshotStore, sources: Sequence[Source]) -> None:
    """Store the sums of all sources, the merged table and the annual summary."""
    sums = store.write(SUMS, union_sources([_shard(s) for s in sources]))
    merged = store.write(UNIFIED, deltas.winners(store.written(sums), KEYS))
    annual = store.write(ANNUAL, _annual(store.written(merged)))
    store.commit([sums, merged, annual])


def _annual(merged: DataFrame) -> DataFrame:
    rows = merged.withColumn("year", F.year("pickup_date")).groupBy(*YEAR).agg(
        F.sum("trips").alias("trips"), F.min("pickup_date").alias("first_date"),
        F.max("pickup_date").alias("last_date"), F.count("pickup_date").alias("days"))
    return _as_year_partition(rows)


def _as_year_partition(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"source": F.lit("all"), "pickup_month": F.col("year").cast("string")})


def correct_month(store: SnapshotStore, source: Source, month: str) -> None:
    """Replace a month of one source by ``source.frame`` and publish what follows from it.

    The change of the shard goes through the merged table (its touched keys are ranked
    again) to the annual rows, whose sums and days change by the difference. First and
    last days are looked up again only where a first or last day was retracted. An
    empty frame retracts the whole month.
    """
    inside = F.col("pickup_month") == month
    sums = store.read(SUMS).filter(inside)  # this month of all sources
    merged = store.read(UNIFIED).filter(inside)
    by_source = ["source", "source_priority", *KEYS]
    shard = _shard(source).filter(inside)
    old = sums.filter(F.col("source") == source.name)
    delta = deltas.signed_delta(old.drop("pickup_month"), shard.drop("pickup_month"), by_source)
    after, change = deltas.merged_change(sums.drop("pickup_month"), delta, KEYS)
    labelled = lambda df: df.withColumn("pickup_month", month_label(F.col("pickup_date")))

    mine = labelled(after.filter(F.col("source") == source.name))
    new_sums = store.write(SUMS, union_sources([deltas.touched(old, delta, KEYS, "left_anti"), mine]))
    # The rows that come and go, stored once: the merged table and the year read them.
    changed = store.write("merged_change", labelled(change))
    change = store.written(changed)
    stay = deltas.touched(merged, change, KEYS, "left_anti")
    new_merged = store.write(UNIFIED, union_sources([stay, change.filter("sign_ = 1").drop("sign_")]))
    new_annual = _corrected_year(store, month[:4], new_merged, month, change)
    parts = store.partitions().filter(F.col("table_name").isin(SUMS, UNIFIED, ANNUAL)).filter(
        (inside & ((F.col("table_name") == UNIFIED) | ((F.col("table_name") == SUMS)
                                                       & (F.col("source") == source.name))))
        | ((F.col("table_name") == ANNUAL) & (F.col("pickup_month") == month[:4]))
    ).select("table_name", "source", "pickup_month").collect()  # partitions of one month
    store.commit([new_sums, new_merged, new_annual], replacing=[tuple(r) for r in parts])


def _corrected_year(store: SnapshotStore, year: str, new_merged: Written, month: str,
                    change: DataFrame) -> Written:
    """The annual rows of a year after the merged rows of one month changed."""
    rows = store.read(ANNUAL).filter(F.col("pickup_month") == year)
    signed = change.withColumn("year", F.year("pickup_date")).groupBy(*YEAR).agg(
        F.sum(F.col("sign_") * F.col("trips")).alias("d_trips"),
        F.sum("sign_").cast("bigint").alias("d_days"),
        F.min(F.when(F.col("sign_") > 0, F.col("pickup_date"))).alias("came_first"),
        F.max(F.when(F.col("sign_") > 0, F.col("pickup_date"))).alias("came_last"),
        F.min(F.when(F.col("sign_") < 0, F.col("pickup_date"))).alias("went_first"),
        F.max(F.when(F.col("sign_") < 0, F.col("pickup_date"))).alias("went_last"),
    )
    joined = rows.join(signed.withColumnsRenamed({"year": "y_", "company": "c_"}),
                       F.col("year").eqNullSafe(F.col("y_")) & F.col("company").eqNullSafe(F.col("c_")), "full")
    at_edge = (F.col("went_first") <= F.col("first_date")) | (F.col("went_last") >= F.col("last_date"))
    totals = joined.select(
        F.coalesce("year", "y_").alias("year"), F.coalesce("company", "c_").alias("company"),
        (F.coalesce("trips", F.lit(0)) + F.coalesce("d_trips", F.lit(0))).alias("trips"),
        F.least("first_date", "came_first").alias("first_date"),
        F.greatest("last_date", "came_last").alias("last_date"),
        (F.coalesce("days", F.lit(0)) + F.coalesce("d_days", F.lit(0))).alias("days"),
        F.coalesce(at_edge, F.lit(False)).alias("at_edge"),
    ).filter("days > 0")
    this_year = store.read(UNIFIED).filter(
        F.col("pickup_month").startswith(year) & (F.col("pickup_month") != month))
    days = union_sources([this_year, store.written(new_merged)]).groupBy(
        F.year("pickup_date").alias("y_"), F.col("company").alias("c_")
    ).agg(F.min("pickup_date").alias("again_first"), F.max("pickup_date").alias("again_last"))
    edges = totals.filter("at_edge").join(
        days, F.col("year").eqNullSafe(F.col("y_")) & F.col("company").eqNullSafe(F.col("c_"))
    ).select("year", "company", "trips", F.col("again_first").alias("first_date"),
             F.col("again_last").alias("last_date"), "days")
    kept = totals.filter("NOT at_edge").drop("at_edge")
    return store.write(ANNUAL, _as_year_partition(kept.unionByName(edges)))


def unified_daily(store: SnapshotStore, snapshot: int | None = None) -> DataFrame:
    """The merged table without the columns that deltas need."""
    rows = store.read(UNIFIED, snapshot)
    return rows.drop(*[c for c in rows.columns if c == deltas.SUPPORT or c.startswith("known_")])


def annual_summary(store: SnapshotStore, snapshot: int | None = None) -> DataFrame:
    return store.read(ANNUAL, snapshot).drop("source", "pickup_month")
