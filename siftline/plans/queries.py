"""All registered queries and their SQL oracles."""

from __future__ import annotations

from siftline.plans import scan_queries, table_queries  # noqa: F401 - register on import
from siftline.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
