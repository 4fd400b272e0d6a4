"""Spark-native engine for select-project-join-sum queries over tables of unsigned 64-bit integers."""

from .plans.query import Filter, Join, Query, QuerySyntaxError, Ref, parse_query
from .plans.planner import plan_query
from .plans.render import render_sql
from .sources.catalog import Catalog
from .streaming.batches import format_line, run_script

__all__ = ["Catalog", "Filter", "Join", "Query", "QuerySyntaxError", "Ref", "format_line", "parse_query", "plan_query", "render_sql", "run_script"]
