"""All registered queries of the grid, series and graph operators."""

from __future__ import annotations

from . import application_queries, descent_queries, extraction_queries, field_queries, fixpoint_queries, graph_queries, grid_queries, propagation_queries, segment_queries, shape_queries, statistic_queries, trace_queries, window_queries  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
