"""Importing this registers all queries of the library."""

from cairn.plans import archives, bundles, relations, scans  # noqa: F401
from cairn.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
