"""Registered queries: each applies an operator to whole tables and names its DuckDB counterpart."""

from strataframe.queries import array_queries, box_queries, column_queries, crop_queries, graph_queries, grid_queries, matching_queries, metric_queries, report_queries, stat_queries, state_queries, supervision_queries, table_queries, transform_queries, window_queries  # noqa: F401
from strataframe.queries.registry import QUERIES, SQL  # noqa: F401
