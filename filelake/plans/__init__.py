"""Queries over the derived views; importing the package registers all of them."""

from . import archive_queries, catalog_queries, column_queries, filter_queries, index_queries, media_queries, search_queries, streaming_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
