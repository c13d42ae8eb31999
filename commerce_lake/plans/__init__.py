"""Registered queries and their SQL."""

from . import analytics_queries, catalog_queries, commerce_queries, intent_queries, recommend_queries, search_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
