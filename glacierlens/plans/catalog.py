"""All registered queries; importing the plan modules fills the registry."""

from __future__ import annotations

from glacierlens.plans import (  # noqa: F401
    altimetry,
    balance,
    climate,
    ensemble,
    gaps,
    scenario,
    sources,
    spatial,
    tasks,
    terrain,
)
from glacierlens.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
