"""Metric queries and training-data operators on Spark."""

from .engine import Engine
from .errors import ParseError, QueryError, UnsupportedError
from .model import Grid
from .plans.parser import ParserOptions, parse, parse_metric, parse_selector, parse_series
from .sources.series import Catalog, FrameSeries, MemorySeries, TableSeries

__all__ = ["Catalog", "Engine", "FrameSeries", "Grid", "MemorySeries", "ParseError", "ParserOptions", "QueryError", "TableSeries", "UnsupportedError", "parse", "parse_metric", "parse_selector", "parse_series"]
