"""All registered queries; importing the query modules fills the registry."""

from ledgerlake.plans import coverage_queries, history_queries, table_queries, text_queries
from ledgerlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "coverage_queries", "history_queries", "table_queries", "text_queries"]
