"""Named queries over the given tables."""

from . import chunk_queries, index_queries, metadata_queries, queue_queries, search_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
