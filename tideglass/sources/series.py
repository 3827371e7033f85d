"""Sources of series: a source answers matchers and a time range with a raw frame."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError
from ..model import NAME, Raw, col
from ..plans.parser import duration_ms, parse_series
from ..plans.syntax import Matcher

STALE_BITS = "0x7ff0000000000002"


@dataclass(frozen=True)
class Hints:
    """What the plan will do with the samples; start and end (inclusive, ms) bind, the others advise."""

    start: int
    end: int
    step: int = 0
    range: int = 0
    func: str = ""
    grouping: tuple[str, ...] = ()


class SeriesSource(Protocol):
    def select(self, spark: SparkSession, matchers: list[Matcher], hints: Hints) -> Raw: ...


def java_regex(pattern: str) -> str:
    """The pattern as a Java regex over the whole value; look-around and back-references are not of the language."""
    if re.search(r"\(\?[=!<](?![A-Za-z])|\\[1-9]", pattern):
        raise QueryError(f"error parsing regexp: invalid or unsupported Perl syntax: `{pattern}`")
    try:
        re.compile(re.sub(r"\(\?[a-zA-Z]+\)|\\[pPzAQE]|\(\?P?<", "(", pattern))
    except re.error as e:
        raise QueryError(f"error parsing regexp: {e}: `{pattern}`") from None
    return rf"(?d)\A(?:{pattern.replace('(?P<', '(?<')})\z"


def accepts(m: Matcher, value: Column) -> Column:
    """Whether a matcher accepts a label's value ("" if absent)."""
    if m.op in ("=", "!="):
        hit = value == m.value
    else:
        hit = value.rlike(java_regex(m.value))
    return ~hit if m.op[0] == "!" else hit


def accepts_text(m: Matcher, value: str) -> bool:
    hit = value == m.value if m.op in ("=", "!=") else re.fullmatch(m.value, value) is not None
    return hit != (m.op[0] == "!")


@dataclass
class TableSeries:
    """One metric in a table: a time column (or expression), a value, and columns that are labels.

    Matchers on labels and the time range are filters on the table's own columns, below any window, so they
    reach the scan.  Null labels are absent; rows without time or value are not samples.
    """

    name: str
    #: The table, or a function from a range in ms (start and end, inclusive) to it, for tables that are grouped from a larger one.
    df: DataFrame | Callable[[int, int], DataFrame]
    ts_ms: Column
    value: Column
    labels: dict[str, Column]
    #: A filter on the table's own time column for a range in ms, so that the scan can skip row groups.
    prune: object = None
    #: Whether NaNs of the table may be staleness markers (by their bits).
    markers: bool = False
    #: Size of the table's files, where each row is a sample.
    size: int = 0

    def select(self, spark: SparkSession, matchers: list[Matcher], hints: Hints) -> Raw:
        df = self.df(hints.start, hints.end) if callable(self.df) else self.df
        if self.prune is not None:
            df = df.where(self.prune(hints.start, hints.end))
        names = tuple(sorted([*self.labels, NAME]))
        for m in matchers:
            if m.name == NAME:
                if not accepts_text(m, self.name):
                    df = df.limit(0)
            elif m.name in self.labels:
                own = self.labels[m.name].cast("string")
                exact = m.op == "=" and m.value != ""
                df = df.where(own == m.value if exact else accepts(m, F.coalesce(own, F.lit(""))))
            elif not accepts_text(m, ""):
                df = df.limit(0)
        out = [F.lit(self.name).alias(col(NAME)) if n == NAME else F.coalesce(self.labels[n].cast("string"), F.lit("")).alias(col(n)) for n in names]
        df = df.select(*out, self.ts_ms.cast("bigint").alias("ts_ms"), self.value.cast("double").alias("value"))
        df = df.where(F.col("ts_ms").between(hints.start, hints.end) & F.col("value").isNotNull())
        stale = F.when(F.isnan("value"), is_stale("value")).otherwise(F.lit(False)) if self.markers else F.lit(False)
        return Raw(df.withColumn("is_stale", stale), names, True, self.size)


@dataclass
class Catalog:
    """Several sources by metric name; a matcher that names one goes to that one, others to all that it accepts."""

    metrics: dict[str, SeriesSource] = field(default_factory=dict)

    def select(self, spark: SparkSession, matchers: list[Matcher], hints: Hints) -> Raw:
        named = [m for m in matchers if m.name == NAME]
        chosen = [s for n, s in self.metrics.items() if all(accepts_text(m, n) for m in named)]
        if not chosen:
            return empty(spark, (NAME,))
        found = [s.select(spark, matchers, hints) for s in chosen]
        if len(found) == 1:
            return found[0]
        names = tuple(sorted(set().union(*(r.labels for r in found))))
        frames = [r.df.select(*(F.col(col(n)) if n in r.labels else F.lit("").alias(col(n)) for n in names), "ts_ms", "value", "is_stale") for r in found]
        df = frames[0]
        for f in frames[1:]:
            df = df.unionByName(f)
        return Raw(df, names, False)


def empty(spark: SparkSession, names: tuple[str, ...]) -> Raw:
    schema = ", ".join([*(f"`{col(n)}` string" for n in names), "ts_ms bigint", "value double", "is_stale boolean"])
    return Raw(spark.createDataFrame([], schema), names)


class MemorySeries:
    """Series from lines such as x{a="b"} 1+1x10 _ stale, a sample every interval from time 0; a later line wins at equal times."""

    def __init__(self, lines: str | list[str] = (), interval: str = "1m"):
        self.series: dict[tuple, dict[int, float | str]] = {}
        if lines:
            self.load(lines, interval)

    def load(self, lines: str | list[str], interval: str) -> MemorySeries:
        step = duration_ms(interval)
        for line in lines.splitlines() if isinstance(lines, str) else lines:
            if line.strip() and not line.strip().startswith("#"):
                labels, values = parse_series(line)
                samples = self.series.setdefault(tuple(sorted(labels.items())), {})
                samples.update((i * step, v) for i, v in enumerate(values) if v is not None)
        return self

    def add(self, labels: dict[str, str], samples: list[tuple[int, float]]) -> MemorySeries:
        self.series.setdefault(tuple(sorted((k, v) for k, v in labels.items() if v)), {}).update(samples)
        return self

    def select(self, spark: SparkSession, matchers: list[Matcher], hints: Hints) -> Raw:
        chosen = [(dict(k), v) for k, v in self.series.items() if all(accepts_text(m, dict(k).get(m.name, "")) for m in matchers)]
        names = tuple(sorted(set().union({NAME}, *(k for k, _ in chosen))))
        rows = [(*(k.get(n, "") for n in names), t, 0.0 if v == "stale" else float(v), v == "stale") for k, samples in chosen for t, v in sorted(samples.items()) if hints.start <= t <= hints.end]
        if not rows:
            return empty(spark, names)
        schema = ", ".join([*(f"`{col(n)}` string" for n in names), "ts_ms bigint", "value double", "is_stale boolean"])
        return Raw(spark.createDataFrame(rows, schema), names, len({k.get(NAME, "") for k, _ in chosen}) == 1)


def long_table(df: DataFrame, labels: str = "labels", ts_ms: str = "ts_ms", value: str = "value") -> DataFrame:
    """Rows of a table with a MAP of labels as label columns; the names take one distinct job."""
    names = sorted(r[0] for r in df.select(F.explode(F.map_keys(labels))).distinct().collect())
    return df.select(*(F.coalesce(F.col(labels)[n], F.lit("")).alias(col(n)) for n in names), F.col(ts_ms).cast("bigint").alias("ts_ms"), F.col(value).cast("double").alias("value"))


def is_stale(value: str) -> Column:
    """Whether a DOUBLE column, as it comes from the file, has the bits of the staleness marker."""
    return F.expr(f"reflect('java.lang.Double', 'doubleToRawLongBits', `{value}`)") == str(int(STALE_BITS, 16))


class FrameSeries:
    """A raw frame as a source: label columns lbl_*, ts_ms, value and is_stale (optional)."""

    def __init__(self, df: DataFrame, markers: bool = False):
        self.names = tuple(sorted(c[len("lbl_") :] for c in df.columns if c.startswith("lbl_")))
        stale = F.when(F.isnan("value"), is_stale("value")).otherwise(F.lit(False)) if markers else F.lit(False)
        self.df = df if "is_stale" in df.columns else df.withColumn("is_stale", stale)

    def select(self, spark: SparkSession, matchers: list[Matcher], hints: Hints) -> Raw:
        df = self.df.where(F.col("ts_ms").between(hints.start, hints.end))
        one = False
        for m in matchers:
            df = df.where(accepts(m, F.col(col(m.name)) if m.name in self.names else F.lit("")))
            one |= m.name == NAME and m.op == "="
        return Raw(df, self.names, one)
