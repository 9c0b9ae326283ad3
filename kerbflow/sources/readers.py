"""Scans of landed files into typed frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kerbflow.functions.categories import event_category
from kerbflow.functions.cleaning import nulls_from_text, to_day
from kerbflow.operators.unify import union_sources
from kerbflow.sources import layouts

Paths = str | Sequence[str]


class MissingColumns(ValueError):
    """A source lacks columns it must have."""


def _as_list(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def require_columns(df: DataFrame, required: Sequence[str], source: str = "input") -> DataFrame:
    present = {c.lower() for c in df.columns}
    missing = sorted(c for c in required if c.lower() not in present)
    if missing:
        raise MissingColumns(f"{source} is missing required columns: {missing}")
    return df


def read_csv(
    spark: SparkSession, paths: Paths, schema: StructType | str,
    rename: Mapping[str, str] | None = None,
) -> DataFrame:
    """Headed CSV with a declared schema; unreadable values become null.

    Files whose header names other columns, or the same in another order, raise an
    error instead of being read by position.
    """
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .csv(_as_list(paths))
    )
    return nulls_from_text(df.withColumnsRenamed(dict(rename or {})))


def read_csv_by_name(
    spark: SparkSession, paths: Paths, schema: StructType | str
) -> DataFrame:
    """Headed CSV files of any column order: each layout is read once, by its header.

    Columns that a file lacks are null, those that the schema lacks are not read.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    groups = layouts.by_layout(layouts.file_layouts(spark, paths))
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    frames = [layouts.by_name(reader.schema(layouts.in_order(columns, schema)).csv(files), schema)
              for columns, files in groups.items()]
    return union_sources(frames) if frames else spark.createDataFrame([], schema)


def read_csv_after_preamble(
    spark: SparkSession, paths: Paths, schema: StructType | str, skip: int,
    rename: Mapping[str, str] | None = None,
) -> DataFrame:
    """CSV whose header follows ``skip`` lines of preamble in every file, read by name.

    The catalogue gives each file's first lines and columns. The text is read once: a
    line of a file that equals one of its first ``skip + 1`` lines is no row. Files
    that lack a column of the schema raise an error.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    catalogue = layouts.file_layouts(spark, paths, "csv", skip)
    filled = catalogue.filter(F.size("columns") > 0)
    _all_files_have(filled, [f.name for f in schema])
    heads = catalogue.select("file", F.explode("head").alias("value")).distinct()
    frames = []
    for columns, files in layouts.by_layout(catalogue).items():
        lines = spark.read.text(files).select("value", F.col("_metadata.file_path").alias("file"))
        body = lines.filter(F.trim("value") != "").join(heads, ["file", "value"], "left_anti")
        names = layouts.in_order(columns, schema)
        row = F.from_csv("value", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names))
        frames.append(layouts.by_name(body.select(row.alias("row")).select("row.*"), schema))
    df = union_sources(frames) if frames else spark.createDataFrame([], schema)
    return nulls_from_text(df.withColumnsRenamed(dict(rename or {})))


def _all_files_have(catalogue: DataFrame, required: Sequence[str]) -> None:
    bad = layouts.files_lacking(catalogue, required)
    if bad:
        raise MissingColumns("; ".join(f"{file} is missing required columns: {c}" for file, c in bad))


def read_parquet_columns(
    spark: SparkSession, paths: Paths, wanted: Sequence[str] = (), required: Sequence[str] = (),
    schema: StructType | str | None = None,
) -> DataFrame:
    """Parquet with only the wanted columns that exist in some file.

    Names match without regard to case, which also covers spelling variants. Every file
    must have the ``required`` columns: all footers are looked at, in parallel. For very
    many files give a ``schema``: then footers are not merged, and a column of the schema
    that a file lacks is null.
    """
    if required:
        _all_files_have(layouts.file_layouts(spark, paths, "parquet"), required)
    if schema is None:
        df = spark.read.option("mergeSchema", True).parquet(*_as_list(paths))
    else:
        df = spark.read.schema(schema).parquet(*_as_list(paths))
    present = {c.lower() for c in df.columns}
    if schema is not None and not wanted:
        return df
    return df.select(*[F.col(w).alias(w) for w in wanted if w.lower() in present])


def read_optional(
    spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet"
) -> DataFrame:
    """A table that may not exist yet: an absent path is an empty frame. CSV columns are
    found by header."""
    try:
        if fmt == "csv":
            return read_csv_by_name(spark, path, schema)
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_month_shards(spark: SparkSession, paths: Sequence[Paths], fmt: str = "csv") -> DataFrame:
    """Month files whose column sets and orders differ, united by name.

    CSV files are grouped by their header, so one entry may hold several layouts; empty
    files add no rows. All columns are text until cast by a table schema.
    """
    if fmt != "csv":
        return union_sources([spark.read.format(fmt).load(p) for p in paths])
    reader = spark.read.option("header", True).option("inferSchema", False)
    files = [x for p in paths for x in _as_list(p)]
    groups = layouts.by_layout(layouts.file_layouts(spark, files))
    if not groups:
        return reader.csv(files)
    return union_sources([reader.csv(group) for group in groups.values()])


def typed(df: DataFrame, schema: StructType) -> DataFrame:
    """Cast text columns to a table's types; absent columns become null."""
    return df.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in df.columns
             else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema
        ]
    )


def read_table(
    spark: SparkSession, path: str, schema: StructType, days: Sequence[str] = ("pickup_date",),
) -> DataFrame:
    """A stored CSV rollup with its dates (``pickup_date``, ``week_start``) parsed."""
    text = spark.read.option("header", True).csv(path)
    dated = {d: to_day(F.col(d)) for d in (*days, "week_start") if d in text.columns}
    return typed(text.withColumns(dated), schema)


def read_custom_events(spark: SparkSession, path: str) -> DataFrame:
    """Optional event file: absent columns are null, rows need a date and a name."""
    columns = ["date", "event_name", "event_category", "venue", "borough"]
    text = ", ".join(f"{c} string" for c in columns)
    try:
        raw = spark.read.option("header", True).csv(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = spark.createDataFrame([], text)
    if not {"date", "event_name"} <= set(raw.columns):
        raw = spark.createDataFrame([], text)
    absent = {c: F.lit(None).cast("string") for c in columns if c not in raw.columns}
    full = nulls_from_text(raw.withColumns(absent) if absent else raw)
    return (
        full.withColumn("date", to_day(F.col("date")))
        .dropna(subset=["date", "event_name"])
        .withColumn("event_category", event_category(F.col("event_category")))
        .select(*columns)
    )


def read_json_rows(spark: SparkSession, paths: Paths, schema: StructType | str) -> DataFrame:
    """Files that each hold one JSON array of flat rows."""
    return spark.read.schema(schema).option("multiLine", True).json(_as_list(paths))


def read_parallel_arrays(
    spark: SparkSession, paths: Paths, fields: Mapping[str, str], root: str = "daily"
) -> DataFrame:
    """Columnar JSON: an object of equally long arrays to one row per position."""
    inner = ", ".join(f"{name}: array<{kind}>" for name, kind in fields.items())
    raw = spark.read.schema(f"{root} struct<{inner}>").option("multiLine", True).json(
        _as_list(paths)
    )
    zipped = F.arrays_zip(*[F.col(f"{root}.{name}").alias(name) for name in fields])
    return raw.select(F.inline(zipped))
