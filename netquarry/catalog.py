"""All queries of the library's own operators."""

from netquarry.plans import association_queries, contrast_queries, feature_queries, function_queries, graph_queries, history_queries, inference_queries, path_queries, source_queries
from netquarry.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "association_queries", "contrast_queries", "feature_queries", "function_queries", "graph_queries", "history_queries", "inference_queries", "path_queries", "source_queries"]
