"""The registered queries; importing a module registers its queries."""

from phantomlake.plans import catalogue_queries, history_queries, image_queries, scalar_queries, series_queries, store_queries
from phantomlake.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "catalogue_queries", "history_queries", "image_queries", "scalar_queries", "series_queries", "store_queries"]
