"""Registry of the queries: importing the query modules fills it."""

from __future__ import annotations

from . import q_grid, q_misc, q_more, q_series  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
