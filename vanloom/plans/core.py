"""Queries of the core operators and their SQL. The registry is filled by the modules below."""

from __future__ import annotations

from vanloom.plans.registry import ORACLE, QUERIES
from vanloom.plans import corpus, coverage, profiles, spans_and_events  # noqa: F401  (they register their queries)

__all__ = ["ORACLE", "QUERIES"]
