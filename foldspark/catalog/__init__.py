"""Registered queries with their DuckDB equivalents."""

from foldspark.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
