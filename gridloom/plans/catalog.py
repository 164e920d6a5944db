"""All registered queries."""

from __future__ import annotations

from . import more_queries, queries  # noqa: F401 - they register
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
