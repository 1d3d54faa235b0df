"""All queries of the library; importing the modules registers them."""

from . import analytics_queries, monitoring_queries, retrieval_queries, service_queries, store_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
