"""Named queries over the given tables, with the SQL that checks them."""

from mailmine.catalog import mining_queries, run_queries, text_queries  # noqa: F401
from mailmine.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
