"""Registered queries."""

from ledgerlens.plans.registry import QUERIES
from ledgerlens.plans import analysis_queries, line_queries, record_queries, reply_queries, rule_queries  # noqa: F401

__all__ = ["QUERIES"]
