"""Queries: operators bound to tables, with equivalent SQL."""

from tracewell.plans import event_queries, report_queries, scan_queries, source_queries, store_queries, stream_queries, summary_queries  # noqa: F401  register their queries
from tracewell.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
