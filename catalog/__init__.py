"""Registered queries: every operator on the given tables, each with the SQL that checks it."""

from catalog import audits, files, leads, profiles  # noqa: F401  (they register themselves)
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
