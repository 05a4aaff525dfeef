"""Queries that bind the operators to the supplied tables."""

from tessera.plans.registry import ORACLE, QUERIES
from tessera.plans import files, indexing, learning, reports, spatial  # noqa: F401

__all__ = ["ORACLE", "QUERIES"]
