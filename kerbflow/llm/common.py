"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbflow.session import shared_folder

#: White space of all contracts, and the words between it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(text: Column | str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back: later steps don't repeat the work,
    and a lost executor costs no more than the tasks it was running."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also inside nested lambdas."""
    return F.transform(F.array(value), body)[0]


def packed_rows(docs: DataFrame, **columns: Column) -> DataFrame:
    """``docs`` as one struct column ``row_`` beside computed columns, so that no name
    of the input can clash."""
    return docs.select(F.struct("*").alias("row_"), *[c.alias(k) for k, c in columns.items()])


def rest_hash(docs: DataFrame) -> Column:
    """Hash of all columns but the text, nulls told apart from any value."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return F.xxhash64(F.to_json(F.struct(*rest))) if rest else F.lit(0).cast("long")


def with_copy_number(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``copy``, which numbers the rows that agree in ``keys`` (not null) from 0.

    ``rows`` has ``row_key`` of monotonically_increasing_id. Equal rows are numbered
    within each partition they were read in, and the counts of the partitions before give
    where a partition begins, so no task gets all copies of a frequent row.
    """
    part = F.shiftright("row_key", 33).alias("part_")
    inside = Window.partitionBy(*keys, "part_").orderBy("row_key")
    placed = rows.select("*", part).withColumn("at_", F.row_number().over(inside))
    sums = placed.groupBy(*keys, "part_").agg(F.max("at_").alias("n_"))
    earlier = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before_", F.sum("n_").over(earlier)).filter("before_ > 0").drop("n_")
    return placed.join(starts, [*keys, "part_"], "left").withColumn(
        "copy", F.col("at_") - 1 + F.coalesce("before_", F.lit(0))
    ).drop("part_", "at_", "before_")


#: Distinct marks of a wanted set: the bound of what ``sifted`` broadcasts.
MARKS = 1 << 21


def sifted(rows: DataFrame, key: Column, wanted: Column, of: DataFrame) -> DataFrame:
    """Rows that may have a key of ``of``: those whose mark (the key's hash modulo MARKS)
    occurs there. Most others stay out of the shuffle of the exact join that follows;
    the marks are at most MARKS numbers however large ``of`` is."""
    mark = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS)).alias("mark_")
    marks = of.select(mark(wanted)).distinct()
    kept = rows.select("*", mark(key)).join(F.broadcast(marks), "mark_", "left_semi")
    return kept.drop("mark_")
