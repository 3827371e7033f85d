"""Aggregations of an instant vector by labels."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.mathx import SMALL, kahan_mean, kahan_sum, max_number, mean, quantile
from ..model import METRIC_LABELS, NAME, Scalar, Vector, col, columns
from .text import number_text

ORDERED = {"topk", "bottomk"}


def group_labels(v: Vector, labels: tuple[str, ...], without: bool) -> tuple[str, ...]:
    if without:
        return tuple(x for x in v.labels if x not in labels and x not in METRIC_LABELS)
    return tuple(sorted(set(labels) & set(v.labels)))


def aggregate(op: str, v: Vector, labels: tuple[str, ...] = (), without: bool = False, param: Scalar | str | None = None, exact: bool = False) -> Vector:
    """`op by (labels)` or `op without (labels)`; a step that no series reaches has no value."""
    keys = group_labels(v, labels, without)
    by = [*columns(keys), "step_ms"]
    keeps = NAME in keys
    df = v.df
    if op in ("topk", "bottomk", "limitk", "limit_ratio"):
        return _subset(op, v, by, param)
    if op == "count_values":
        if not param or not (param.replace("_", "a").isalnum() and not param[0].isdigit()):
            raise QueryError(f'invalid label name "{param}"')
        df = df.withColumn("text", number_text(F.col("value")))
        keys = tuple(x for x in keys if x != param)
        out = df.groupBy(*columns(keys), F.col("text").alias(col(param)), "step_ms").agg(F.count(F.lit(1)).cast("double").alias("value"))
        names = tuple(sorted({*keys, param}))
        return Vector(out.select(*columns(names), "step_ms", "value", F.lit(False).alias("drop_name")), names, True, size=v.size)
    value = F.col("value")
    drop = F.max("drop_name") if keeps else F.first(F.lit(False))
    if op == "quantile":
        df = param.attach(df.groupBy(*by).agg(F.collect_list("value").alias("vs"), drop.alias("drop_name")))
        out = df.select(*by, quantile(param.expr, F.col("vs")).alias("value"), "drop_name")
        return Vector(out, keys, not keeps, size=v.size)
    if exact and op in ("sum", "avg"):
        order = F.array_sort(F.collect_list(F.struct(*columns(v.labels), "value")))
        total = kahan_sum(F.transform(order, lambda x: x["value"]))
        agg = total if op == "sum" else kahan_mean(F.transform(order, lambda x: x["value"]))
    else:
        agg = {
            "sum": lambda: F.sum(value), "avg": lambda: mean(F.sum(value), F.sum(value * SMALL), F.count(F.lit(1))), "count": lambda: F.count(F.lit(1)).cast("double"), "min": lambda: F.min(value),
            "max": lambda: max_number(value), "group": lambda: F.min(F.lit(1.0)), "stddev": lambda: F.stddev_pop(value), "stdvar": lambda: F.var_pop(value),
        }[op]()
    return Vector(df.groupBy(*by).agg(agg.alias("value"), drop.alias("drop_name")), keys, not keeps, size=v.size)


def _subset(op: str, v: Vector, by: list[str], param: Scalar) -> Vector:
    """Some series of each group and step, with all their labels."""
    df = param.attach(v.df)
    hashed: Column = F.xxhash64(*columns(v.labels)) if v.labels else F.lit(0).cast("bigint")
    failing = F.isnan(param.expr)
    fail = F.raise_error(F.lit("Parameter value is NaN")).cast("boolean")
    if op == "limit_ratio":
        r = F.greatest(F.least(param.expr, F.lit(1.0)), F.lit(-1.0))
        share = F.pmod(hashed, F.lit(1 << 30)) / float(1 << 30)
        keep = F.when(failing, fail).when(r >= 0, share < r).otherwise(share >= 1.0 + r)
        return v.with_df(df.where(keep).select(*v.df.columns), order=[])
    k = F.when(failing, F.lit(0)).otherwise(F.greatest(F.least(param.expr, F.lit(2.0**31 - 1)), F.lit(0.0)).cast("int"))
    value = F.col("value")
    order = [hashed] if op == "limitk" else [F.isnan(value), value.desc() if op == "topk" else value.asc(), hashed]
    w = Window.partitionBy(*by).orderBy(*order, *columns(v.labels))
    keep = F.when(failing, fail).otherwise(F.col("place") <= k)
    out = df.withColumn("place", F.row_number().over(w)).where(keep).select(*v.df.columns)
    ranks = [] if op == "limitk" else [F.isnan(value), value.desc() if op == "topk" else value.asc()]
    return v.with_df(out, order=ranks)
