"""Registered queries over the test tables and the SQL they are checked against."""

from . import detector_queries, job_queries, ledger_queries, lifecycle_queries, measure_queries, register_queries, series_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
