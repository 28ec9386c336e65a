"""Queries over the provided tables, one or more per operator, with their SQL where SQL can say it."""

from workload import counting, gaps, linking, retrieval, rows, staging, texts  # noqa: F401  (registers the queries)
from workload.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
