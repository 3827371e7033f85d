"""From an evaluated frame to a result."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import METRIC_LABELS, Vector, col, columns
from .select import dealt
from .text import label_order

SAME = "vector cannot contain metrics with the same labelset"


def finish(v: Vector) -> Vector:
    """Names that are to go, gone; two series with the same labels at a step fail the query.

    The check costs a shuffle and is left out where the plan shows that no two series can become one.
    """
    if v.nameless:
        v = replace(v, labels=tuple(x for x in v.labels if x not in METRIC_LABELS))
    gone = F.col("drop_name")
    df = v.df.select(*((F.when(gone, "").otherwise(F.col(col(x))) if x in METRIC_LABELS else F.col(col(x))).alias(col(x)) for x in v.labels), "step_ms", "value")
    if not v.unique:
        n = F.count(F.lit(1)).over(Window.partitionBy(*columns(v.labels), "step_ms"))
        df = dealt(df, v.size, [*columns(v.labels), "step_ms"]).withColumn("n", n).where(F.when(F.col("n") > 1, F.raise_error(F.lit(SAME)).cast("boolean")).otherwise(True)).drop("n")
    return Vector(df, v.labels, True, v.order)


def result(v: Vector, ordered: bool = False) -> DataFrame:
    """Label columns by their own names (value and step_ms keep theirs; such labels stay prefixed)."""
    df = v.df
    if ordered:
        df = df.orderBy(*(v.order or [label_order(v)]), "step_ms")
    return df.select(*(F.col(col(x)).alias(x if x not in ("value", "step_ms") else col(x)) for x in v.labels), "step_ms", "value")
