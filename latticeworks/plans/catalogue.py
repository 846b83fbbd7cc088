"""The registered queries over the reference's own operators, each with its SQL twin."""

from __future__ import annotations

from . import checks, features, fields, lands, places, scenes, tables  # noqa: F401  they register their queries
from .registry import ORACLE, QUERIES

FLAGSHIP = "chunk_report"

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
