"""All queries of the library, by name."""

from . import exercises, graph, ingest, learning, retrieve, review, streams  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
