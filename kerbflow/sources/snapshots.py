"""Tables that are published together: new partitions become visible with one log row.

Data files are never replaced. A write puts partitions under a version of their own,
which nobody reads yet; a commit appends one row that names the partitions of every table
it changes. A reader resolves all tables by one snapshot number, so it sees a refresh
whole or not at all, and a failure between two tables leaves what was published as it is.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kerbflow.sources.readers import read_optional

PARTITIONS = ("source", "pickup_month")
PARTS = ("array<struct<table_name: string, source: string, pickup_month: string, "
         "version: string, columns: string, rows: bigint>>")
LOG = f"snapshot bigint, committed timestamp, parts {PARTS}"


@dataclass(frozen=True)
class Part:
    """One partition of a table as a commit names it; without a version it is removed."""

    table_name: str
    source: str
    pickup_month: str
    version: str | None
    columns: str | None
    rows: int


@dataclass(frozen=True)
class Written:
    """What one write stored, not yet published."""

    table_name: str
    version: str
    columns: str


def local_rows(spark: SparkSession, rows: Sequence[dict], schema: str) -> DataFrame:
    """A few rows as a local relation: no Python worker runs when they are read."""
    kind = to_arrow_schema(StructType.fromDDL(schema))
    return spark.createDataFrame(pa.Table.from_pylist(list(rows), kind), schema)


class SnapshotStore:
    """Tables partitioned by source and month below ``root``, and the log of commits.

    One writer at a time: two commits of one number are an error when they are read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- writing

    def write(self, table: str, df: DataFrame) -> Written:
        """Store the partitions that occur in ``df`` without publishing them.

        The rebalance hint gathers small partitions into full files and splits large ones.
        """
        version = uuid.uuid4().hex
        path = f"{self.root}/data/{table}/version={version}"
        df.hint("rebalance", *PARTITIONS).write.partitionBy(*PARTITIONS).parquet(path)
        values = df.drop(*PARTITIONS)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema)
        return Written(table, version, columns)

    def written(self, one: Written) -> DataFrame:
        """A table as just written, published or not."""
        return self._read(one.table_name, [one.version], one.columns).drop("version")

    def commit(self, tables: Sequence[Written],
               replacing: Sequence[tuple[str, str, str]] = ()) -> list[Part]:
        """Publish what was written to any number of tables in one row of the log; the
        parts published.

        The parts are counted on what was written, all tables in one job. Partitions of
        ``replacing`` (table, source, month) that were not written anew are taken out.
        Without any part nothing is published.
        """
        counts = [
            self.written(w).groupBy(*PARTITIONS).agg(F.count(F.lit(1)).alias("rows"))
            .select(F.lit(k).alias("k"), *PARTITIONS, "rows") for k, w in enumerate(tables)
        ]
        rows = reduce(DataFrame.unionAll, counts).collect() if counts else []  # a row a partition
        parts = [Part(tables[r["k"]].table_name, r["source"], r["pickup_month"],
                      tables[r["k"]].version, tables[r["k"]].columns, r["rows"]) for r in rows]
        new = {(p.table_name, p.source, p.pickup_month) for p in parts}
        parts += [Part(*key, None, None, 0) for key in replacing if key not in new]
        if parts:
            number = (self.latest() or 0) + 1
            row = local_rows(self.spark, [{"snapshot": number, "parts": [vars(p) for p in parts]}],
                             f"snapshot bigint, parts {PARTS}")
            row.select("snapshot", F.current_timestamp().alias("committed"), "parts").coalesce(
                1).write.mode("append").parquet(f"{self.root}/log")
        return parts

    # -- reading

    def log(self) -> DataFrame:
        return read_optional(self.spark, f"{self.root}/log", LOG)

    def latest(self) -> int | None:
        """Number of the last snapshot."""
        row = self.log().agg(F.max("snapshot").alias("last"), F.count_distinct("snapshot").alias("n"),
                             F.count(F.lit(1)).alias("commits")).first()
        if row["n"] != row["commits"]:
            raise ValueError(f"two commits share a snapshot number below {self.root}")
        return row["last"]

    def partitions(self, snapshot: int | None = None) -> DataFrame:
        """(table_name, source, pickup_month, version, columns, rows, snapshot): the parts
        that hold at a snapshot, by default the last; one row a table, source and month."""
        log = self.log() if snapshot is None else self.log().filter(F.col("snapshot") <= snapshot)
        parts = log.select("snapshot", F.inline("parts"))
        newest = parts.groupBy("table_name", *PARTITIONS).agg(
            F.max_by(F.struct("version", "columns", "rows", "snapshot"), "snapshot").alias("p"))
        return newest.select("table_name", *PARTITIONS, "p.*").filter("version IS NOT NULL")

    def read(self, table: str, snapshot: int | None = None) -> DataFrame:
        """A table at a snapshot. Only the folders of live versions are listed, and of
        these only the partitions that the snapshot names are read; versions of other
        columns are united by name, what one lacks is null."""
        live = self.partitions(snapshot).filter(F.col("table_name") == table).select(
            *PARTITIONS, "version", "columns").collect()  # one row a source and month
        if not live:
            raise ValueError(f"{table!r} has no partition at snapshot {snapshot}")
        frames = []
        for columns in sorted({r["columns"] for r in live}):
            named = [r for r in live if r["columns"] == columns]
            wanted = local_rows(
                self.spark, [{k: r[k] for k in ("version", *PARTITIONS)} for r in named],
                "version string, source string, pickup_month string")
            rows = self._read(table, sorted({r["version"] for r in named}), columns)
            frames.append(rows.join(wanted, ["version", *PARTITIONS], "left_semi").drop("version"))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def _read(self, table: str, versions: Sequence[str], columns: str) -> DataFrame:
        base = f"{self.root}/data/{table}"
        schema = f"{columns}, version string, source string, pickup_month string"
        return self.spark.read.schema(schema).option("basePath", base).parquet(
            *[f"{base}/version={v}" for v in versions])

    # -- upkeep

    def unused_versions(self, keep: int = 1) -> list[str]:
        """Folders of versions that none of the last ``keep`` snapshots reads: of older
        snapshots, or of refreshes that failed before their commit."""
        last = self.latest() or 0
        live = set()
        for number in range(max(last - keep + 1, 1), last + 1):
            live |= {(r["table_name"], r["version"]) for r in
                     self.partitions(number).select("table_name", "version").distinct().collect()}
        files = self.spark._jvm.org.apache.hadoop.fs
        data = files.Path(f"{self.root}/data")
        system = data.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(data):
            return []
        found = []
        for table in system.listStatus(data):
            for version in system.listStatus(table.getPath()):
                name = version.getPath().getName().removeprefix("version=")
                if (table.getPath().getName(), name) not in live:
                    found.append(version.getPath().toString())
        return sorted(found)

    def clean(self, keep: int = 1) -> int:
        """Delete the unused versions (no refresh may be running); how many there were."""
        unused = self.unused_versions(keep)
        for folder in unused:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return len(unused)
