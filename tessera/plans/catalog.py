"""All verification queries of the core library."""

from __future__ import annotations

from tessera.plans import geometry_queries, model_queries, reference_queries, relational_queries, scan_queries, series_queries, summary_queries  # noqa: F401  (they register their queries)
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
