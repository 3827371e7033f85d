"""Queries over a source of series."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import QueryError
from .model import LOOKBACK, Grid
from .operators.finalize import finish, result
from .plans.check import check, type_of
from .plans.parser import ParserOptions, duration_ms, parse, print_tree
from .plans.planner import Planner
from .plans.syntax import MATRIX, SCALAR, STRING, VECTOR, unwrap
from .sources.series import SeriesSource


def ms(t: int | float | str) -> int:
    """Milliseconds of seconds (a number) or a duration such as 5m."""
    return duration_ms(t) if isinstance(t, str) else round(t * 1000)


@dataclass
class Engine:
    """Plans queries as lazy DataFrames; times are seconds or durations.

    exact: order-sensitive compensated sums instead of Spark's own.
    """

    spark: SparkSession
    source: SeriesSource
    lookback: int | str = LOOKBACK // 1000
    options: ParserOptions = field(default_factory=ParserOptions)
    exact: bool = False
    default_step: int | str = 60

    def _planner(self, grid: Grid, instant: bool) -> Planner:
        lookback = ms(self.lookback)
        return Planner(self.spark, self.source, grid, lookback if lookback > 0 else LOOKBACK, self.exact, instant, ms(self.default_step))

    def _checked(self, query: str):
        e = parse(query, self.options)
        check(e)
        return e

    def range_query(self, query: str, start, end, step, ordered: bool = False) -> DataFrame:
        """A row for each series and step: labels, step_ms, value."""
        e = self._checked(query)
        if type_of(e) not in (SCALAR, VECTOR):
            raise QueryError(f'invalid expression type "{type_of(e)}" for range query, must be Scalar or instant Vector')
        v = self._planner(Grid(ms(start), ms(end), ms(step)), False).vector(e)
        return result(finish(v), ordered)

    def instant_query(self, query: str, at, ordered: bool = True) -> DataFrame | str:
        """A vector or scalar: labels, step_ms, value; a range vector: labels, ts_ms, value; a string: itself."""
        e = self._checked(query)
        kind = type_of(e)
        if kind == STRING:
            return unwrap(e).value
        planner = self._planner(Grid(ms(at), ms(at), 1), True)
        if kind == MATRIX:
            df = planner.matrix(unwrap(e))
            return df.select(*(F.col(c).alias(c.removeprefix("lbl_")) for c in df.columns))
        return result(finish(planner.vector(e)), ordered)

    def series(self, query: str, start, end, step) -> DataFrame:
        """The result of a range query as a row for each series with an array of (step_ms, value)."""
        df = self.range_query(query, start, end, step)
        labels = [c for c in df.columns if c not in ("step_ms", "value")]
        return df.groupBy(*labels).agg(F.array_sort(F.collect_list(F.struct("step_ms", "value"))).alias("samples"))

    def explain(self, query: str, start=0, end=0, step=1) -> str:
        """The syntax tree and Spark's plan of a query."""
        e = self._checked(query)
        df = self.range_query(query, start, end, step)
        return print_tree(e) + "\n\n" + df._jdf.queryExecution().toString()
