"""Named queries over the driver's tables."""

from . import gate_queries, handoff_queries, queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
