"""Every registered query by name, with SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from tilth.plans import accuracy, aggregates, calibration, cropcycles, domain, evaluations, fits, ingest, monitor, observed, outlines, performance, projections, records, relations, rollups, scoring, seasons, stateful, zoning  # noqa: F401  they register
from tilth.plans.base import QUERIES, SQL

FLAGSHIP = "portfolio_by_risk"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
