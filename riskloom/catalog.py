"""Every registered query of the engine, with the SQL that checks it."""

from __future__ import annotations

from .plans import decisions, graphs, ledger, models, streams, tables  # noqa: F401  the modules register their queries
from .plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
