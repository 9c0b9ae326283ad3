"""What columns each file of a folder has, found in parallel from headers and footers.

A catalogue has one row for each file. Only the first lines of a CSV file or the footer of
a Parquet file are read, by tasks that each get some of the files; Spark lists the files
and never opens them for this. Files are then read by name, those of one layout together.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: ``head`` has the lines up to and with the header (CSV), ``columns`` the names as written.
LAYOUT = "file string, path string, head array<string>, columns array<string>"
FILES_A_TASK = 64
HEAD_BYTES = 16 << 10


def _source(path: str):
    """File system and place of a path as Spark lists it."""
    from pyarrow import fs

    local = re.match(r"file:/*(/.*)$", path)
    return (fs.LocalFileSystem(), local.group(1)) if local else fs.FileSystem.from_uri(path)


def first_lines(path: str, n: int) -> list[str]:
    """The first ``n`` lines of a text file (gzip too): a few KB are read, more only if
    the lines are longer. Of an empty file none."""
    system, place = _source(path)
    data = b""
    with system.open_input_stream(place, compression="detect") as stream:
        while data.count(b"\n") < n and (more := stream.read(HEAD_BYTES)):
            data += more
    lines = data.decode("utf-8-sig", "replace").split("\n")
    return [x.removesuffix("\r") for x in lines[:n]] if data else []


def header(line: str) -> list[str]:
    return next(csv.reader([line]), [])


def footer(path: str) -> list[str]:
    import pyarrow.parquet as pq

    system, place = _source(path)
    with system.open_input_file(place) as file:
        return pq.ParquetFile(file).schema_arrow.names


def file_layouts(spark: SparkSession, paths: str | Sequence[str], fmt: str = "csv",
                 skip: int = 0) -> DataFrame:
    """One row of LAYOUT for each file; ``skip`` lines come before a CSV header."""
    places = [paths] if isinstance(paths, str) else list(paths)
    pattern = {"pathGlobFilter": "*.parquet"} if fmt == "parquet" else {}
    files = spark.read.format("binaryFile").options(**pattern).load(places).select(
        F.col("_metadata.file_path").alias("file"), "path")
    tasks = max(1, -(-len(files.inputFiles()) // FILES_A_TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.string())
        for batch in batches:
            heads, columns = [], []
            for path in batch.column(1).to_pylist():
                head = [] if fmt == "parquet" else first_lines(path, skip + 1)
                heads.append(head)
                columns.append(footer(path) if fmt == "parquet" else header(head[skip]) if len(head) > skip else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(heads, kind), pa.array(columns, kind)],
                names=["file", "path", "head", "columns"])

    return files.repartition(tasks).mapInArrow(run, LAYOUT)


def by_layout(catalogue: DataFrame) -> dict[tuple[str, ...], list[str]]:
    """Paths by columns (files without any are left out), as a reader takes them."""
    rows = catalogue.groupBy("columns").agg(F.array_sort(F.collect_list("path")).alias("paths")).collect()
    return {tuple(r["columns"]): r["paths"] for r in sorted(rows, key=lambda r: r["paths"]) if r["columns"]}


def files_lacking(catalogue: DataFrame, required: Sequence[str], most: int = 5) -> list[tuple[str, list[str]]]:
    """Up to ``most`` files that lack required columns (case ignored), and which."""
    have = F.transform("columns", lambda c: F.lower(F.trim(c)))
    need = F.array(*[F.lit(c) for c in required])
    lacking = F.filter(need, lambda c: ~F.array_contains(have, F.lower(c)))
    rows = catalogue.select("file", lacking.alias("lacking")).filter(F.size("lacking") > 0)
    return [tuple(r) for r in rows.orderBy("file").limit(most).collect()]


def in_order(columns: Sequence[str], schema: StructType, rename: Mapping[str, str] | None = None) -> StructType:
    """The types of ``schema`` in the order of a file's columns, under its names; a column
    that the schema lacks is text."""
    known = {f.name.strip().lower(): f.dataType for f in schema}
    return StructType([
        StructField((rename or {}).get(c, c), known.get(c.strip().lower(), StringType())) for c in columns])


def by_name(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of ``schema``, found without regard to case and blanks around names;
    absent ones are null."""
    have = {c.strip().lower(): c for c in reversed(df.columns)}
    return df.select(*[
        (F.col(f"`{have[f.name.strip().lower()]}`") if f.name.strip().lower() in have
         else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])
