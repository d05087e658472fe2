"""The catalogue of queries over the driver's tables, with their SQL."""

from __future__ import annotations

from loomstone.plans import data_queries, index_queries, more_queries, record_queries, report_queries, segment_queries, text_queries  # noqa: F401
from loomstone.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
