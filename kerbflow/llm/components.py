"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbflow.llm.common import stage


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.filter("b > a").join(least, "a").select(
        F.col("b").alias("a"), F.col("m").alias("b")
    ).filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(key, component) of every key of ``edges`` (a, b): the smallest key reachable.

    Large and small stars in turn; each round's edges are stored in the shared folder.
    A key with many neighbours is never gathered: minima are aggregates, and the join
    that hands them out can be split. Rounds grow with the logarithm of the longest
    path. Loops and repeated edges don't matter; no edges give no rows.
    """
    now = stage(edges.filter("a != b").select("a", "b").distinct(), "edges")
    before = _signature(now)
    while before[0]:
        now = stage(_small_star(_large_star(now)), "edges")
        after = _signature(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("key"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("key"), F.col("b").alias("component")).unionByName(
        roots
    ).distinct()
