"""Registered queries, each with the SQL that states its expected result."""

from . import aggregates, checks, joins, rows, tables  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
