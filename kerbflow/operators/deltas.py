"""Signed deltas: what a corrected shard changes in the sums built on it.

A delta has the keys of a rollup and, for each measure, new less old sum. ``support_`` is
the change in the number of rows behind a key and ``known_<measure>`` that of the rows in
which the measure is known, so that retracted keys go and sums without any known
value become null again. Deltas add up, so corrections may come in any order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbflow.operators.rollup import sums_of
from kerbflow.operators.unify import best_source, union_sources

SUPPORT = "support_"


def _known(measure: str) -> str:
    return f"known_{measure}"


def measures_of(rows: DataFrame, keys: Sequence[str]) -> list[str]:
    own = {SUPPORT, *(c for c in rows.columns if c.startswith("known_"))}
    return [m for m in sums_of(rows, keys) if m not in own]


def with_support(rollup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A rollup as sums that deltas can be added to: keys, measures, support."""
    rows = rollup if SUPPORT in rollup.columns else rollup.withColumn(SUPPORT, F.lit(1).cast("bigint"))
    measures = measures_of(rows, keys)
    known = {_known(m): F.col(m).isNotNull().cast("bigint") for m in measures
             if _known(m) not in rows.columns}
    rows = rows.withColumns(known) if known else rows
    return rows.select(*keys, SUPPORT, *measures, *map(_known, measures))


def added(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Sums and deltas added up; keys without support go. Every measure that one of the
    parts has is kept; null keys are keys."""
    rows = union_sources(list(parts))
    measures = measures_of(rows, keys)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (SUPPORT, *map(_known, measures))]
    total = rows.groupBy(*keys).agg(*sums, *[F.sum(m).alias(m) for m in measures])
    changed = F.col(SUPPORT) != 0
    for m in measures:
        changed = changed | (F.col(_known(m)) != 0) | (F.col(m) != 0)
    return total.filter(F.coalesce(changed, F.lit(False)))


def negated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    values = [c for c in rows.columns if c not in keys]
    return rows.select(*keys, *[(-F.col(c)).alias(c) for c in values])


def signed_delta(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What has to be added to sums over ``old`` to get those over ``new``."""
    return added([negated(with_support(old, keys), keys), with_support(new, keys)], keys)


def apply_delta(sums: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums after a delta; measures that no row behind a key knows are null."""
    total = added([with_support(sums, keys), delta], keys).filter(F.col(SUPPORT) > 0)
    measures = measures_of(total, keys)
    return total.withColumns(
        {m: F.when(F.col(_known(m)) > 0, F.col(m)) for m in measures}) if measures else total


def touched(rows: DataFrame, delta: DataFrame, keys: Sequence[str], how: str = "left_semi") -> DataFrame:
    """The rows whose key a delta changes (with ``left_anti`` the others); null keys
    match each other."""
    asked = delta.select(*[F.col(k).alias(f"{k}_") for k in keys]).distinct()
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"{k}_"))
        same = one if same is None else same & one
    return rows.join(asked, same, how)


def winners(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row of the highest-priority source of each key."""
    return best_source(sums, keys, [F.asc("source")])


def merged_change(sums: DataFrame, delta: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(sums of all sources after a delta, change of the merged table) for the keys that
    the delta touches: only these are ranked again. The change has the merged rows that
    go (``sign_`` -1) and come (1)."""
    by_source = ["source", "source_priority", *keys]
    before = touched(sums, delta, keys)
    after = apply_delta(before, delta, by_source)
    old, new = (winners(df, keys).withColumn("sign_", F.lit(s)) for df, s in ((before, -1), (after, 1)))
    return after, union_sources([old, new])
