"""Queries over the given tables, and the SQL to hold them against."""

from . import evaluation_queries, graph_queries, inventory_queries, io_queries, more_queries, search_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
