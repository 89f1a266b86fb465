"""The queries of the core, with their SQL for DuckDB."""

from granary.plans import corpus, files, monitor, pairs, streams, strings, vectors  # noqa: F401
from granary.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
