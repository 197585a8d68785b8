"""Registered queries of the engine and their DuckDB counterparts."""

from __future__ import annotations

from driftmerge.plans import files  # noqa: F401  registers its queries
from driftmerge.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
