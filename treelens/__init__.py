"""Typed property graphs on Spark: declarative tree queries, derived fields,
views with expansion and viewport, and events of what changes in them."""

from .operators.events import diff, in_order, window_state
from .operators.mutations import as_of, log_frame, watch
from .operators.rollups import with_fields
from .operators.view import ALL, Expansion, Forest, View
from .paths import TreePath
from .plans.access import explain_query
from .plans.query import Query, Selection, parse_query, query, select
from .schema import Schema, parse_schema
from .sources.graph import EdgePairs, Graph

__all__ = [
    "ALL", "EdgePairs", "Expansion", "Forest", "Graph", "Query", "Schema", "Selection", "TreePath", "View", "as_of", "diff",
    "explain_query", "in_order", "log_frame", "parse_query", "parse_schema", "query", "select", "watch", "window_state", "with_fields",
]
