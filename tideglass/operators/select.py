"""Selectors: which samples a step sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import NAME, Grid, Raw, Vector, columns

#: Size of a table's files for each part that its series are dealt to; some 50,000 samples of events.
PART_BYTES = 1 << 20


def dealt(df: DataFrame, size: int, keys: list[str]) -> DataFrame:
    """Rows by key, in parts as many as the size of the files asks for, so that one part's memory does not grow with them.

    The session's number of shuffle partitions is fixed, and AQE joins them to what it holds for enough bytes of shuffle; what
    windows and aggregates hold is many times that.
    """
    parts = size // PART_BYTES
    return df if parts < 2 or not keys else df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism), *keys)


def by_series(raw: Raw) -> DataFrame:
    """The samples, each series in one part."""
    return dealt(raw.df, raw.size, columns(n for n in raw.labels if n != NAME or not raw.one_name))


def series_window(raw: Raw):
    return Window.partitionBy(*columns(raw.labels)).orderBy("ts_ms")


def steps(df: DataFrame, first: Column, behind: Column, grid: Grid, out: list) -> DataFrame:
    """Explodes rows to the steps from number `first` to before `behind`."""
    low = F.greatest(first, F.lit(0).cast("bigint"))
    high = F.least(behind, F.lit(grid.count).cast("bigint")) - 1
    df = df.withColumn("k0", low).withColumn("k1", high).where("k0 <= k1")
    df = df.select(*out, F.explode(F.sequence("k0", "k1")).alias("k"))
    return df.withColumn("step_ms", F.col("k") * grid.step + grid.start).drop("k")


def instant(raw: Raw, grid: Grid, lookback: int, offset: int = 0, timestamps: bool = False) -> Vector:
    """The latest sample of each series in (step - lookback, step]; none if that one is a staleness marker.

    A sample owns the steps from its time until the next sample's or until it is too old, so
    each sample becomes the steps it owns: one shuffle by series, no join with the grid.
    """
    w = series_window(raw)
    df = by_series(raw).withColumn("next", F.lead("ts_ms").over(w)).where("not is_stale")
    until = F.least(F.coalesce("next", F.lit(2**62)), F.col("ts_ms") + lookback)
    df = steps(df, grid.index(F.col("ts_ms") + offset), grid.index(until + offset), grid, [*columns(raw.labels), "ts_ms", "value"])
    value = F.col("ts_ms") / 1000.0 if timestamps else F.col("value")
    return Vector(df.select(*columns(raw.labels), "step_ms", value.alias("value"), F.lit(timestamps).alias("drop_name")), raw.labels, True, size=raw.size)


def window_start(width: int, offset: int) -> Column:
    return F.col("step_ms") - (offset + width)


def in_windows(df: DataFrame, labels, grid: Grid, width: int, offset: int, keep: list) -> DataFrame:
    """Samples at every step whose window (step - offset - width, step - offset] holds them."""
    first = grid.index(F.col("ts_ms") + offset)
    behind = grid.index(F.col("ts_ms") + (offset + width))
    return steps(df, first, behind, grid, [*columns(labels), "ts_ms", *keep])


def raw_range(raw: Raw, at: int, width: int, offset: int = 0) -> DataFrame:
    """The samples of a range selector at the root of an instant query."""
    end = at - offset
    return raw.df.where((F.col("ts_ms") > end - width) & (F.col("ts_ms") <= end) & ~F.col("is_stale")).select(*columns(raw.labels), "ts_ms", "value")
