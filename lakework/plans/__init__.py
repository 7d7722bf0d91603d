"""Registered queries over the given tables, each beside its SQL oracle."""

from lakework.plans import areas, feed, pixels, raster, relational, storage, streams, vector  # noqa: F401 - register queries
from lakework.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
