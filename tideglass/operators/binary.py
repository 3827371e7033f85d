"""Operators between two operands: arithmetic, comparison and sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import ARITHMETIC, COMPARISON
from ..model import METRIC_LABELS, NAME, Scalar, Vector, col, columns
from ..plans.syntax import Matching
from .select import dealt

FLIPPED = {"==": "==", "!=": "!=", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


def scalars(op: str, a: Scalar, b: Scalar) -> Scalar:
    if op in ARITHMETIC:
        expr = ARITHMETIC[op](a.expr, b.expr)
    else:
        expr = F.when(COMPARISON[op](a.expr, b.expr), 1.0).otherwise(0.0)
    names = {n for _, n in a.sources}
    return Scalar(expr, a.sources + tuple(s for s in b.sources if s[1] not in names))


def with_scalar(op: str, v: Vector, s: Scalar, flag: bool, scalar_left: bool) -> Vector:
    """A vector and a scalar; a comparison keeps the vector's value."""
    df, x, y = s.attach(v.df), F.col("value"), s.expr
    a, b = (y, x) if scalar_left else (x, y)
    if op in ARITHMETIC:
        value, keep, drop = ARITHMETIC[op](a, b), None, True
    elif flag:
        value, keep, drop = F.when(COMPARISON[op](a, b), 1.0).otherwise(0.0), None, True
    else:
        value, keep, drop = x, COMPARISON[op](a, b), False
    df = df.where(keep) if keep is not None else df
    drops = F.lit(True) if drop else F.col("drop_name")
    return Vector(df.select(*columns(v.labels), "step_ms", value.alias("value"), drops.alias("drop_name")), v.labels, v.unique and (not drop or _one_name(v)), nameless=drop or v.nameless, size=v.size)


def _one_name(v: Vector) -> bool:
    return v.one_name or NAME not in v.labels


def signature(a: Vector, b: Vector, m: Matching) -> tuple[str, ...]:
    if m.on:
        return tuple(sorted(set(m.labels)))
    return tuple(sorted((set(a.labels) | set(b.labels)) - set(METRIC_LABELS) - set(m.labels)))


def _keyed(v: Vector, keys: tuple[str, ...], mark: str) -> DataFrame:
    """The vector with its match key in columns of their own; a label that is not there is ""."""
    return v.df.select(*(F.col(c).alias(f"{mark}_{c}") for c in v.df.columns), *(v.label(k).alias(f"key_{k}") for k in keys))


def sets(op: str, a: Vector, b: Vector, m: Matching) -> Vector:
    """and, unless, or: by match key and step."""
    keys = signature(a, b, m)
    on = [f"key_{k}" for k in keys] + ["key_step"]
    left = _keyed(a, keys, "l").withColumn("key_step", F.col("l_step_ms"))
    right = _keyed(b, keys, "r").withColumn("key_step", F.col("r_step_ms"))
    if op in ("and", "unless"):
        out = left.join(right.select(*on).distinct(), on, "left_semi" if op == "and" else "left_anti")
        return a.with_df(out.select(*(F.col(f"l_{c}").alias(c) for c in a.df.columns)), order=[])
    rest = right.join(left.select(*on).distinct(), on, "left_anti")
    names = tuple(sorted({*a.labels, *b.labels}))
    out = [*columns(names), "step_ms", "value", "drop_name"]
    mine = a.df.select(*(a.label(n).alias(col(n)) for n in names), "step_ms", "value", "drop_name")
    others = rest.select(*((F.col(f"r_{col(n)}") if n in b.labels else F.lit("")).alias(col(n)) for n in names), *(F.col(f"r_{c}").alias(c) for c in ("step_ms", "value", "drop_name")))
    return Vector(mine.unionByName(others).select(*out), names, False, size=max(a.size, b.size))


def _once(df: DataFrame, on: list[str], message: str, other: DataFrame, unique: bool) -> DataFrame:
    """df, failing where a key has several rows at a step that the other side has, too."""
    if unique:
        return df
    counted = df.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*on)))
    several = counted.where("n > 1").select(*on).distinct().join(other.select(*on).distinct(), on, "left_semi")
    marked = counted.drop("n").join(several.withColumn("several", F.lit(True)), on, "left")
    return marked.where(F.when(F.col("several"), F.raise_error(F.lit(message)).cast("boolean")).otherwise(True)).drop("several")


def _is_key(v: Vector, keys: tuple[str, ...]) -> bool:
    """Whether a key holds all labels of the vector but its one name."""
    return v.unique and set(v.labels) - set(keys) <= ({NAME} if v.one_name else set())


def vectors(op: str, a: Vector, b: Vector, flag: bool, m: Matching) -> Vector:
    """Arithmetic and comparison of two vectors by match key and step, in parts by size of the larger one's files."""
    keys = signature(a, b, m)
    on = [f"key_{k}" for k in keys] + ["key_step"]
    size = max(a.size, b.size)
    left = dealt(_keyed(a, keys, "l").withColumn("key_step", F.col("l_step_ms")), size, on)
    right = dealt(_keyed(b, keys, "r").withColumn("key_step", F.col("r_step_ms")), size, on)
    many, one = ("r", "l") if m.card == "group_right" else ("l", "r")
    v_many, v_one = (b, a) if many == "r" else (a, b)
    text = ", ".join(keys)
    side = "left" if one == "l" else "right"
    duplicate = f"found duplicate series for the match group ({text}) on the {side} hand-side of the operation; many-to-many matching not allowed: matching labels must be unique on one side"
    if one == "r":
        right = _once(right, on, duplicate, left, _is_key(b, keys))
    else:
        left = _once(left, on, duplicate, right, _is_key(a, keys))
    if m.card == "one-to-one":
        left = _once(left, on, "multiple matches for labels: many-to-one matching must be explicit (group_left/group_right)", right, _is_key(a, keys))
    filled = m.fill_left is not None or m.fill_right is not None
    how = "inner"
    if filled:
        how = "full" if m.fill_left is not None and m.fill_right is not None else "right" if m.fill_left is not None else "left"
    df = left.join(right, on, how)
    x, y = F.col("l_value"), F.col("r_value")
    if m.fill_left is not None:
        x = F.coalesce(x, F.lit(float(m.fill_left)))
    if m.fill_right is not None:
        y = F.coalesce(y, F.lit(float(m.fill_right)))
    if op in ARITHMETIC:
        value, keep, drop = ARITHMETIC[op](x, y), None, True
    elif flag:
        value, keep, drop = F.when(COMPARISON[op](x, y), 1.0).otherwise(0.0), None, True
    else:
        value, keep, drop = x, COMPARISON[op](x, y), False
    df = df.where(keep) if keep is not None else df

    def label(n: str) -> Column:
        if m.card == "one-to-one":
            got = F.col(f"{many}_{col(n)}") if n == NAME else F.col(f"key_{n}")
        elif n in m.include:
            got = F.col(f"{one}_{col(n)}") if n in v_one.labels else F.lit("")
        else:
            got = F.col(f"{many}_{col(n)}") if n in v_many.labels else F.lit("")
            if n in keys:
                got = F.coalesce(got, F.col(f"key_{n}"))
        return F.coalesce(got, F.lit(""))

    if m.card == "one-to-one":
        names = set(keys) | ({NAME} & set(a.labels) if not drop and (not m.on or NAME in keys) else set())
        if not m.on:
            names |= {NAME} & set(a.labels) if not drop else set()
    else:
        names = set(v_many.labels) | set(m.include) | (set(keys) if filled else set())
    names = tuple(sorted(names))
    drops = F.lit(True) if drop else F.coalesce(F.col(f"{many}_drop_name"), F.lit(True))
    out = df.select(*(label(n).alias(col(n)) for n in names), F.col("key_step").alias("step_ms"), value.alias("value"), drops.alias("drop_name"))
    if m.card == "one-to-one":
        unique = drop or NAME not in names
    else:  # a row of the many side has one match at most, and its labels stay as they are
        own = _is_key(v_many, tuple(set(v_many.labels) - set(METRIC_LABELS))) if drop else v_many.unique
        unique = own and not filled and not set(m.include) & set(v_many.labels)
    return Vector(out, names, unique, nameless=drop, size=size)
