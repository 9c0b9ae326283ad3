"""Month-by-month refresh of the stored rollups."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbflow.operators.rollup import GRAINS, base_rollup, five_grains, re_sum, to_grain
from kerbflow.sources.incremental import pending_months
from kerbflow.sources.readers import read_optional
from kerbflow.sources.sinks import manifest
from kerbflow.sources.snapshots import SnapshotStore, local_rows

LOG = ("source string, month string, table_name string, status string, rows long, "
       "message string, finished timestamp")
ZONED = "daily_by_zone"


def run_log(spark: SparkSession, out: str) -> DataFrame:
    return read_optional(spark, f"{out}/run_log", LOG)


def finished_months(spark: SparkSession, out: str, source: str) -> DataFrame:
    """(table_name, month) of what is stored of a source."""
    latest = run_log(spark, out).filter(F.col("source") == source).groupBy(
        "month", "table_name"
    ).agg(F.max_by("status", "finished").alias("status"))
    return latest.filter("status = 'done'").select("table_name", "month")


def refresh_months(
    spark: SparkSession,
    months: DataFrame,
    load_month: Callable[[str], DataFrame],
    zones: DataFrame,
    out: str,
    source: str,
    entity: Sequence[str] = ("company",),
    fill: str | None = None,
    overwrite: bool = False,
    skip_zone: bool = False,
    batch: int = 12,
) -> DataFrame:
    """Store all grains of every due month; returns the run log.

    A month is due while any table that is asked for is missing for this source. Due
    months are taken ``batch`` at a time, those with the same columns in one pass: the
    base rollup is written partitioned by month and read back with its schema, then
    each grain is written once, so trips are scanned once and a lost executor costs no
    second scan. Base and grains of a pass are published by one commit of the snapshot
    store, so readers never see half of it. If a pass fails, nothing of it is published
    and its months are tried one by one; a month that fails alone is logged with its
    error and the others go on. A month without rows is logged as ``empty``, keeps what
    was stored before and stays due.
    """
    tables = [g for g in GRAINS if not (skip_zone and g == ZONED)]
    stored = finished_months(spark, out, source)
    stored = stored.filter(F.col("table_name").isin(tables))
    due = months if overwrite else pending_months(months, stored, len(tables))
    waiting: list[tuple[str, DataFrame]] = []

    def store(group: list[tuple[str, DataFrame]]) -> None:
        try:
            counts = _store_months(spark, group, zones, out, source, entity, fill, tables)
        except Exception as error:  # whatever a loader or a sink raises must not end the run
            if len(group) > 1:
                for one in group:
                    store([one])
            else:
                _log(spark, out, source, [(group[0][0], t, "failed", None, _message(error)) for t in tables])
            return
        _log(spark, out, source, [
            (month, t, "done" if counts.get((month, t)) else "empty", counts.get((month, t), 0), "")
            for month, _ in group for t in tables
        ])

    def flush() -> None:
        by_columns: dict[tuple, list] = {}
        for month, trips in waiting:
            by_columns.setdefault(tuple(sorted(trips.dtypes)), []).append((month, trips))
        for group in by_columns.values():
            store(group)
        waiting.clear()

    for row in due.orderBy("month").toLocalIterator():
        try:
            waiting.append((row["month"], load_month(row["month"])))
        except Exception as error:
            _log(spark, out, source, [(row["month"], t, "failed", None, _message(error)) for t in tables])
        if len(waiting) == batch:
            flush()
    flush()
    return run_log(spark, out)


def _message(error: Exception) -> str:
    lines = str(error).splitlines()
    return f"{type(error).__name__}: {lines[0] if lines else ''}"


def _log(spark: SparkSession, out: str, source: str, entries: list[tuple]) -> None:
    names = ("source", "month", "table_name", "status", "rows", "message")
    frame = local_rows(spark, [dict(zip(names, (source, *e))) for e in entries],
                       LOG.removesuffix(", finished timestamp"))
    frame.withColumn("finished", F.current_timestamp()).coalesce(1).write.mode("append").parquet(
        f"{out}/run_log"
    )


def _store_months(spark, group, zones, out, source, entity, fill, tables) -> dict:
    """Write and publish the tables of some months; rows by (month, table)."""
    store = SnapshotStore(spark, out)
    labelled = reduce(
        DataFrame.unionByName, [t.withColumn("pickup_month", F.lit(m)) for m, t in group]
    )
    base = base_rollup(labelled, entity).withColumn("source", F.lit(source))
    written = [store.write("base", base)]
    stored = store.written(written[0]).drop("source")
    grains = five_grains(stored, zones, entity, fill, ZONED not in tables)
    for grain, df in grains.items():
        if "pickup_month" not in df.columns:  # weekdays and hours, month by month
            df = to_grain(stored, grain, (*entity, "pickup_month"))
        written.append(store.write(grain, df.withColumn("source", F.lit(source))))
    return {(p.pickup_month, p.table_name): p.rows for p in store.commit(written)}


def stored_grain(
    spark: SparkSession, out: str, grain: str, entity: Sequence[str] = ("company",),
    snapshot: int | None = None,
) -> DataFrame:
    """A stored grain over all months at a snapshot (default: the last); weekday-hour
    rows, all their measures, are summed over months."""
    df = SnapshotStore(spark, out).read(grain, snapshot)
    if grain != "weekday_hour_by_company":
        return df
    return re_sum(df.drop("pickup_month"), ["source", *GRAINS[grain], *entity])


def stored_manifest(spark: SparkSession, out: str, grains: Sequence[str] = tuple(GRAINS)) -> DataFrame:
    """Row counts and day ranges of all grains, resolved by one snapshot."""
    snapshot = SnapshotStore(spark, out).latest()
    return manifest({g: stored_grain(spark, out, g, snapshot=snapshot) for g in grains})
