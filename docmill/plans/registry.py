"""The registered queries and their SQL."""

from __future__ import annotations

from docmill.plans import documents, more, operations, schedules, similar, stored, streams  # noqa: F401  they register their queries
from docmill.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
