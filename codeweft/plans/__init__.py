"""Registered queries: the graph's in ``suite``, those of pages and shapes in ``pages``, those of symbols, Lua and bodies in ``declared``."""

from . import declared, pages  # noqa: F401  (they register theirs)
from .suite import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
