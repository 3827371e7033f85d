"""Functions that rewrite labels, and classic histograms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.mathx import nan
from ..model import METRIC_LABELS, NAME, Scalar, Vector, col, columns
from ..sources.series import java_regex


def _valid(label: str) -> None:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", label):
        raise QueryError(f'invalid destination label name in label_replace(): "{label}"')


def _set(v: Vector, label: str, value: Column) -> Vector:
    names = tuple(sorted({*v.labels, label}))
    drop = F.lit(False) if label == NAME else F.col("drop_name")
    df = v.df.select(*((value if n == label else v.label(n)).alias(col(n)) for n in names), "step_ms", "value", drop.alias("drop_name"))
    return Vector(df, names, False, size=v.size)


def replace(v: Vector, dst: str, replacement: str, src: str, pattern: str) -> Vector:
    """label_replace: where the whole value of src matches, dst becomes the replacement with its groups filled in."""
    _valid(dst)
    regex = java_regex(pattern)
    groups = re.compile(re.sub(r"\(\?<", "(?P<", pattern.replace("(?P<", "(?<"))).groups if pattern else 0
    named = re.compile(re.sub(r"\(\?<", "(?P<", pattern.replace("(?P<", "(?<"))).groupindex if pattern else {}
    parts, at = [], 0
    for m in re.finditer(r"\$(?:(\$)|(\w+)|\{(\w+)\})", replacement):
        parts.append(F.lit(replacement[at : m.start()]))
        at = m.end()
        name = m[2] or m[3]
        if m[1]:
            parts.append(F.lit("$"))
        elif name.isdigit() and int(name) <= groups:
            parts.append(F.regexp_extract(v.label(src), regex, int(name)))
        elif name in named:
            parts.append(F.regexp_extract(v.label(src), regex, named[name]))
    parts.append(F.lit(replacement[at:]))
    hit = v.label(src).rlike(regex)
    out = _set(v, dst, F.when(hit, F.concat(*parts)).otherwise(v.label(dst)))
    if dst == NAME:  # rows that did not match keep what was to happen to their name
        drop = F.when(hit, F.lit(False)).otherwise(F.col("drop_name"))
        df = v.df.select(*((F.when(hit, F.concat(*parts)).otherwise(v.label(dst)) if n == dst else v.label(n)).alias(col(n)) for n in out.labels), "step_ms", "value", drop.alias("drop_name"))
        out = out.with_df(df)
    return out


def join(v: Vector, dst: str, separator: str, sources: list[str]) -> Vector:
    """label_join: the values of labels, with a separator between them."""
    _valid(dst)
    return _set(v, dst, F.concat_ws(separator, *(v.label(s) for s in sources)) if sources else F.lit(""))


def _bound(le: Column) -> Column:
    return F.when(le.isin("+Inf", "Inf", "inf", "+inf"), float("inf")).when(le.isin("-Inf", "-inf"), float("-inf")).otherwise(le.try_cast("double"))


def _buckets(v: Vector) -> tuple[Vector, tuple[str, ...]]:
    """For each histogram and step, an array of (upper bound, cumulative count), equal bounds summed, counts made monotone."""
    keys = tuple(x for x in v.labels if x != "le" and x not in METRIC_LABELS)
    df = v.df.withColumn("bound", _bound(v.label("le"))).where("bound is not null")
    df = df.groupBy(*columns(keys), "step_ms", "bound").agg(F.sum("value").alias("n"))
    df = df.groupBy(*columns(keys), "step_ms").agg(F.array_sort(F.collect_list(F.struct("bound", "n"))).alias("raw"))
    start = F.struct(F.lit(float("-inf")).alias("most"), F.expr("cast(array() as array<struct<bound:double,n:double>>)").alias("out"))

    def fold(a: Column, x: Column) -> Column:
        most = F.greatest(a["most"], x["n"])
        return F.struct(most.alias("most"), F.concat(a["out"], F.array(F.struct(x["bound"].alias("bound"), most.alias("n")))).alias("out"))

    df = df.withColumn("b", F.aggregate("raw", start, fold, lambda a: a["out"]))
    df = df.withColumn("total", F.get(F.col("b.n"), F.size("b") - 1)).withColumn("closed", F.get(F.col("b.bound"), F.size("b") - 1) == float("inf"))
    return Vector(df, keys, True), keys


def quantile(phi: Scalar, v: Vector) -> Vector:
    """histogram_quantile over classic buckets: linear inside the bucket that holds the rank."""
    h, keys = _buckets(v)
    df, p = phi.attach(h.df), phi.expr
    rank = p * F.col("total")
    df = df.withColumn("rank", rank)
    i = F.size(F.filter("b", lambda x: x["n"] < F.col("rank")))
    df = df.withColumn("i", F.least(i, F.size("b") - 1))
    bound, n = F.get(F.col("b.bound"), F.col("i")), F.get(F.col("b.n"), F.col("i"))
    low = F.when(F.col("i") > 0, F.get(F.col("b.bound"), F.col("i") - 1)).otherwise(0.0)
    under = F.when(F.col("i") > 0, F.get(F.col("b.n"), F.col("i") - 1)).otherwise(0.0)
    share = (F.col("rank") - under) / F.when(n != under, n - under).otherwise(1.0)
    value = (
        F.when(~F.col("closed") | (F.size("b") < 2) | (F.col("total") == 0) | F.isnan("total") | F.isnan(p), nan())
        .when(p < 0, float("-inf"))
        .when(p > 1, float("inf"))
        .when(bound == float("inf"), F.get(F.col("b.bound"), F.size("b") - 2))
        .when((F.col("i") == 0) & (bound <= 0), bound)
        .otherwise(low + (bound - low) * share)
    )
    return Vector(df.select(*columns(keys), "step_ms", value.alias("value"), F.lit(True).alias("drop_name")), keys, True)


def fraction(low: Scalar, high: Scalar, v: Vector) -> Vector:
    """histogram_fraction over classic buckets: the share of observations between two bounds."""
    h, keys = _buckets(v)
    df = low.attach(high.attach(h.df)).withColumn("lo", low.expr).withColumn("hi", high.expr)

    def below(x: str) -> Column:
        df_x = F.col(x)
        k = F.size(F.filter("b", lambda e: e["bound"] <= df_x))
        upto = F.when(k > 0, F.get(F.col("b.n"), k - 1)).otherwise(0.0)
        next_n, next_b = F.get(F.col("b.n"), k), F.get(F.col("b.bound"), k)
        first = (k == 0) & (next_b <= 0)
        from_ = F.when(k > 0, F.get(F.col("b.bound"), k - 1)).otherwise(0.0)
        inside = (next_n - upto) * (df_x - from_) / F.when(next_b != from_, next_b - from_).otherwise(1.0)
        return F.when(next_b.isNull() | (next_b == float("inf")) | first | (from_ == float("-inf")) | (df_x <= from_), upto).otherwise(upto + inside)

    value = (
        F.when(~F.col("closed") | (F.col("total") == 0) | F.isnan("total") | F.isnan("lo") | F.isnan("hi"), nan())
        .when(F.col("lo") >= F.col("hi"), 0.0)
        .otherwise((below("hi") - below("lo")) / F.when(F.col("total") != 0, F.col("total")).otherwise(1.0))
    )
    return Vector(df.select(*columns(keys), "step_ms", value.alias("value"), F.lit(True).alias("drop_name")), keys, True)


def info(v: Vector, target: Vector, wanted: tuple[str, ...] | None, required: bool, identify: tuple[str, ...] = ("instance", "job")) -> Vector:
    """Labels of info series added to series with the same identifying labels; a label that is there already wins."""
    data = tuple(x for x in target.labels if x not in identify and x not in METRIC_LABELS and (wanted is None or x in wanted))
    names = tuple(sorted({*v.labels, *data}))
    on = [v.label(k) == F.col(f"i_{k}") for k in identify]
    t = target.df.groupBy(*(target.label(k).alias(f"i_{k}") for k in identify), F.col("step_ms").alias("i_step")).agg(*(F.max(col(d)).alias(f"d_{d}") for d in data), F.max(F.lit(True)).alias("there"))
    cond = F.col("step_ms") == F.col("i_step")
    for c in on:
        cond = cond & c
    df = v.df.join(t, cond, "left")
    if required:
        df = df.where("there")

    def label(n: str) -> Column:
        own = v.label(n)
        return F.when(own == "", F.coalesce(F.col(f"d_{n}"), F.lit(""))).otherwise(own) if n in data else own

    return Vector(df.select(*(label(n).alias(col(n)) for n in names), "step_ms", "value", "drop_name"), names, v.unique)
