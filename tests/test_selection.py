"""Distributed selection against sorted lists, and the volume floor built on it."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest

from kerbflow.operators import growth, selection


@pytest.mark.parametrize("kind, values", [
    ("bigint", [5, 5, 5, 1, 9, -2**63, 2**63 - 1, 0, None, 7, 7]),
    ("double", [0.1, 0.1 + 2**-56, -1.7e308, 1.7e308, 0.0, 5e-324, None, float("nan"), 3.5, 3.5]),
    ("bigint", [random.Random(1).randint(-10**12, 10**12) for _ in range(300)]),
])
def test_kth_smallest(spark, kind, values, monkeypatch):
    monkeypatch.setattr(selection, "PARTS", 8)  # several rounds
    frame = spark.createDataFrame([(v,) for v in values], f"value {kind}").cache()
    ordered = sorted(v for v in values if v is not None and v == v)
    for k in sorted({0, 1, 2, len(ordered) // 2, len(ordered) - 2, len(ordered) - 1}):
        assert selection.kth_smallest(frame, k) == ordered[k]


def test_quantiles_interpolate(spark):
    rng = random.Random(3)
    values = [rng.uniform(-50, 50) for _ in range(101)]
    frame = spark.createDataFrame([(v,) for v in values], "value double").cache()
    for q in (0.0, 0.333, 0.5, 0.999, 1.0):
        assert selection.exact_quantile(frame, q) == pytest.approx(np.quantile(values, q), rel=1e-12)
    assert selection.exact_quantile(frame.limit(0), 0.5) is None


@pytest.mark.parametrize("rank_by", ["largest_gains", "growth"])
def test_many_groups_rank_like_few(spark, rank_by):
    rng = random.Random(5)
    rows = [(dt.date(2024, m, 10), f"g{g}", rng.randint(1, 90)) for m in (1, 2, 3) for g in range(40)]
    daily = spark.createDataFrame(rows, "pickup_date date, zone string, trips bigint")
    one, many = (growth.growth_opportunities(daily, ["zone"], 1, 10, 0.6, rank_by, many_groups=m).collect()
                 for m in (False, True))
    assert one == many and one
