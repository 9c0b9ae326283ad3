"""Ranks by prefix sums over ranges."""

from __future__ import annotations

import random

import pytest

from kerbflow.operators.market import competitor_rank


@pytest.mark.parametrize("tasks", [None, 1, 7, 40])
@pytest.mark.parametrize("volumes", [1, 3, 60])
def test_equal_volumes_share_a_rank_over_ranges(spark, tasks, volumes):
    rng = random.Random(volumes)
    totals = {f"op{k}": rng.randint(1, volumes) for k in range(200)} | {f"none{k}": None for k in range(9)}
    rows = [(k, n, 1) for k, n in totals.items()] + [(k, 0, 2) for k in totals if totals[k] is not None]
    supply = spark.createDataFrame(rows, "operator string, trips bigint, vehicles bigint").repartition(5)
    got = {r["operator"]: (r["trips"], r["rank"]) for r in competitor_rank(supply, "operator", tasks).collect()}
    above = lambda n: sum(m is not None and (n is None or m > n) for m in totals.values())
    assert got == {k: (n, 1 + above(n)) for k, n in totals.items()}


def test_no_operators(spark):
    none = spark.createDataFrame([], "operator string, trips bigint, vehicles bigint")
    assert competitor_rank(none, "operator").collect() == []
