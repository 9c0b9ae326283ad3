"""Queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from kerbflow.plans.catalog import (  # noqa: F401  (imported to register their queries)
    cleaning,
    context,
    events,
    forecasts,
    growth,
    ingest,
    rollups,
    series,
    spatial,
    unified,
)
from kerbflow.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
