"""The shapes that operators pass on.

An evaluated frame has a row for each series and step: a STRING column for each label (`lbl_` before its
name; "" is an absent label), step_ms BIGINT, value DOUBLE and drop_name BOOLEAN, which says that the name goes
from the result.  A raw frame has label columns, ts_ms BIGINT, value DOUBLE and is_stale BOOLEAN.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import QueryError

PREFIX, NAME = "lbl_", "__name__"
#: Labels that go with the name of a metric.
METRIC_LABELS = (NAME, "__type__", "__unit__")
LOOKBACK, MOST_STEPS = 300_000, 1_000_000


def col(label: str) -> str:
    return PREFIX + label


def columns(labels) -> list[str]:
    return [col(x) for x in labels]


def _quotient(whole: Column, by: int) -> Column:
    """Of a multiple of `by`, in integers."""
    return F.call_function("div", whole, F.lit(by).cast("bigint"))


@dataclass(frozen=True)
class Grid:
    """Steps start, start + step, ... up to end; all in ms."""

    start: int
    end: int
    step: int

    def __post_init__(self):
        if self.step <= 0:
            raise QueryError("zero or negative query resolution step widths are not accepted")
        if self.end < self.start:
            raise QueryError("the end of a query is before its start")
        if self.count > MOST_STEPS:
            raise QueryError(f"exceeded the maximum of {MOST_STEPS} steps")

    @property
    def count(self) -> int:
        return (self.end - self.start) // self.step + 1

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.count).select((F.col("id") * self.step + self.start).alias("step_ms"))

    def index(self, ms: Column) -> Column:
        """Number of the first step at or after a time: an integer ceiling, exact for either sign."""
        d = ms - F.lit(self.start)
        up = d + F.pmod(-d, F.lit(self.step))
        return up if self.step == 1 else _quotient(up, self.step)


@dataclass
class Vector:
    """An evaluated frame.  `labels` are sorted; `unique`: no two series can become one when names go."""

    df: DataFrame
    labels: tuple[str, ...]
    unique: bool = False
    order: list = field(default_factory=list)
    #: Every row's name is to go.
    nameless: bool = False
    #: All series have the same name.
    one_name: bool = False
    #: Size of the files it comes from; 0: not known.
    size: int = 0

    def with_df(self, df: DataFrame, **changes) -> Vector:
        return replace(self, df=df, **changes)

    def label(self, name: str) -> Column:
        return F.col(col(name)) if name in self.labels else F.lit("")


@dataclass
class Raw:
    """A raw frame; drop_name says whether the names of its series are to go."""

    df: DataFrame
    labels: tuple[str, ...]
    one_name: bool = False
    #: Size of the files it comes from; 0: not known, or grouped from them.
    size: int = 0


@dataclass
class Scalar:
    """A number for each step: an expression of step_ms and of the columns of `sources`, frames of step_ms and one column."""

    expr: Column
    sources: tuple[tuple[DataFrame, str], ...] = ()
    constant: float | None = None

    def attach(self, df: DataFrame) -> DataFrame:
        """df with the columns that expr needs; a source has a row for every step of the grid."""
        for frame, name in self.sources:
            if name not in df.columns:
                df = df.join(frame, "step_ms")
        return df
