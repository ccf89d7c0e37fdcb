"""All named queries and their SQL: importing a module of queries registers them."""

from __future__ import annotations

from . import extended
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "extended"]
