"""Published yearly totals from published month shards.

Set GOLDEN_TABLES to a folder that holds ``monthly/<family>/<table>/*.csv`` and an
annual summary CSV; the shards are only read.
"""

from __future__ import annotations

import csv
import os
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql.types import StructType

from kerbflow.operators import unify
from kerbflow.operators.rollup import re_sum
from kerbflow.operators.unify import Source
from kerbflow.sources.readers import read_month_shards, typed

ROOT = os.environ.get("GOLDEN_TABLES", "")
pytestmark = pytest.mark.skipif(not ROOT, reason="GOLDEN_TABLES is not set")
COLUMNS = "pickup_date date, pickup_month string, company string, trips bigint"


def shard_source(spark, folder: Path, priority: int) -> Source:
    layouts = defaultdict(list)
    for path in sorted(folder.glob("*.csv")):
        with path.open() as lines:
            layouts[lines.readline()].append(str(path))
    rows = typed(read_month_shards(spark, list(layouts.values())), StructType.fromDDL(COLUMNS))
    return Source(folder.name, priority, re_sum(rows, ["pickup_date", "pickup_month", "company"]))


@pytest.fixture(scope="module")
def sources(spark):
    folders = sorted(Path(ROOT).glob("monthly/*/*daily_by_company"))
    return [shard_source(spark, f, 30 + 10 * i) for i, f in enumerate(folders)]


def published() -> dict[int, tuple]:
    path = next(Path(ROOT).rglob("*annual_summary.csv"))
    with path.open() as lines:
        rows = csv.DictReader(lines)
        return {int(r["year"]): (int(r["trips"]), r["first_date"], r["last_date"], int(r["days"]))
                for r in rows}


def by_year(daily):
    return {
        r.year: (r.trips, str(r.first_date), str(r.last_date), r.days)
        for r in unify.annual_summary(daily).collect()
    }


def test_compatible_totals_equal_the_published_ones(sources):
    got = by_year(unify.daily_by_company(sources, tie_break="month_label"))
    want = published()
    assert len(got) == 12
    assert got == {year: want[year] for year in got}


def test_default_totals_keep_the_rows_the_label_rule_loses(sources):
    want = published()
    got = by_year(unify.daily_by_company(sources))
    more = {year: got[year][0] - want[year][0] for year in got if got[year][0] != want[year][0]}
    assert more == {2018: 4, 2022: 432_792, 2023: 473_319}
