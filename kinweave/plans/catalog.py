"""Every core query with its SQL twin where there is one."""

from __future__ import annotations

from kinweave.plans import drift_queries, entity_queries, linkage_queries, read_queries, record_queries  # noqa: F401
from kinweave.plans.registry import QUERIES, SQL

QUERIES |= drift_queries.QUERIES
SQL |= drift_queries.SQL
