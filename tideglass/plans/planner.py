"""From the syntax tree to frames, bottom up."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError, UnsupportedError
from ..functions import mathx
from ..functions.mathx import ELEMENTWISE
from ..model import LOOKBACK, NAME, Grid, Raw, Scalar, Vector, col, columns
from ..operators import aggregate, binary, labels, rangefn, select, text
from ..sources.series import Hints, SeriesSource
from .check import type_of
from .syntax import SCALAR, SETS, TRIMS, Aggregate, Binary, Call, Duration, Matcher, Matrix, Number, Paren, Selector, String, Subquery, Unary, unwrap

NATIVE_HISTOGRAMS = {"histogram_avg", "histogram_count", "histogram_sum", "histogram_stddev", "histogram_stdvar"}


@dataclass
class Planner:
    spark: SparkSession
    source: SeriesSource
    grid: Grid
    lookback: int = LOOKBACK
    exact: bool = False
    instant: bool = False
    default_step: int = 60_000
    outer: Grid | None = None
    hint: tuple[str, tuple[str, ...]] = ("", ())
    counter: itertools.count = field(default_factory=itertools.count)

    # durations and times

    def ms(self, d: int | Duration) -> int:
        if not isinstance(d, Duration):
            return d
        return round(self._seconds(d) * 1000)

    def _seconds(self, d: int | Duration) -> float:
        if not isinstance(d, Duration):
            return d / 1000
        if d.op == "step":
            return 0.0 if self.instant else self.grid.step / 1000
        if d.op == "range":
            g = self.outer or self.grid
            return (g.end - g.start) / 1000
        a = [self._seconds(x) for x in d.args]
        try:
            return {"neg": lambda: -a[0], "+": lambda: a[0] + a[1], "-": lambda: a[0] - a[1], "*": lambda: a[0] * a[1], "/": lambda: a[0] / a[1], "%": lambda: math.fmod(a[0], a[1]), "^": lambda: a[0] ** a[1], "min": lambda: min(a), "max": lambda: max(a)}[d.op]()
        except (ZeroDivisionError, ValueError):
            raise QueryError("division by zero in a duration expression" if d.op == "/" else "modulo by zero in a duration expression") from None

    def at(self, e) -> int | None:
        outer = self.outer or self.grid
        return {"start": outer.start, "end": outer.end}.get(e.at, e.at)

    def width(self, d) -> int:
        width = self.ms(d)
        if width <= 0:
            raise QueryError("duration must be greater than 0")
        return width

    def pinned(self, at: int) -> Planner:
        return replace(self, grid=Grid(at, at, 1), outer=self.outer or self.grid, instant=True)

    def repeat(self, v: Vector) -> Vector:
        """What holds at one pinned time, at every step."""
        steps = self.grid.frame(self.spark)
        df = v.df.drop("step_ms").crossJoin(F.broadcast(steps) if self.grid.count <= 100_000 else steps).select(*columns(v.labels), "step_ms", "value", "drop_name")
        return v.with_df(df)

    # expressions

    def scalar(self, e) -> Scalar:
        e = unwrap(e)
        match e:
            case Number():
                return Scalar(F.lit(float(e.value)), (), float(e.value))
            case Unary():
                s = self.scalar(e.expr)
                return Scalar(-s.expr, s.sources) if e.op == "-" else s
            case Binary():
                return binary.scalars(e.op, self.scalar(e.lhs), self.scalar(e.rhs))
            case Call(name="time"):
                return Scalar(F.col("step_ms") / 1000.0)
            case Call(name="pi"):
                return Scalar(F.lit(math.pi), (), math.pi)
            case Call(name="start") | Call(name="end") | Call(name="step") | Call(name="range"):
                g = self.outer or self.grid
                x = {"start": g.start, "end": g.end, "step": 0 if self.instant else g.step, "range": g.end - g.start}[e.name] / 1000
                return Scalar(F.lit(x), (), x)
            case Call(name="scalar"):
                v = self.vector(e.args[0])
                name = f"scalar_{next(self.counter)}"
                one = v.df.groupBy("step_ms").agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("v"))
                frame = self.grid.frame(self.spark).join(one, "step_ms", "left").select("step_ms", F.when(F.col("n") == 1, F.col("v")).otherwise(mathx.nan()).alias(name))
                return Scalar(F.col(name), ((frame, name),))
        raise UnsupportedError(f"scalar expression {e!r}")

    def vector(self, e) -> Vector:
        e = unwrap(e)
        if type_of(e) == SCALAR:
            return self.from_scalar(self.scalar(e))
        match e:
            case Selector():
                return self.selector(e)
            case Unary():
                v = self.vector(e.expr)
                return v if e.op == "+" else _named(v.with_df(v.df.withColumn("value", -F.col("value")).withColumn("drop_name", F.lit(True)), unique=v.unique and _one_name(v), nameless=True), v)
            case Aggregate():
                param = None if e.param is None else unwrap(e.param).value if e.op == "count_values" else self.scalar(e.param)
                inner = replace(self, hint=(e.op, () if e.without else e.labels))
                return aggregate.aggregate(e.op, inner.vector(e.expr), e.labels, e.without, param, self.exact)
            case Binary():
                return self.binary(e)
            case Call():
                return self.call(e)
        raise UnsupportedError(f"{type(e).__name__} as an instant vector")

    def from_scalar(self, s: Scalar) -> Vector:
        df = s.attach(self.grid.frame(self.spark)).select("step_ms", s.expr.cast("double").alias("value"), F.lit(False).alias("drop_name"))
        return Vector(df, (), True)

    def binary(self, e: Binary) -> Vector:
        left, right = type_of(e.lhs) == SCALAR, type_of(e.rhs) == SCALAR
        if e.op in TRIMS:
            raise UnsupportedError(f'the operator "{e.op}" of native histograms')
        plain = replace(self, hint=("", ()))
        if left or right:
            v, s = plain.vector(e.rhs if left else e.lhs), plain.scalar(e.lhs if left else e.rhs)
            return _named(binary.with_scalar(e.op, v, s, e.bool, left), v)
        a, b = plain.vector(e.lhs), plain.vector(e.rhs)
        return binary.sets(e.op, a, b, e.matching) if e.op in SETS else binary.vectors(e.op, a, b, e.bool, e.matching)

    def raw(self, s: Selector, width: int, offset: int, func: str = "", after: int = 0) -> Raw:
        """Samples that any window of the grid can hold."""
        if s.ignore_buckets:
            raise UnsupportedError("the __ignore_histogram_buckets__ modifier")
        hints = Hints(self.grid.start - offset - width + 1, self.grid.end - offset + after, self.grid.step, width, func or self.hint[0], self.hint[1])
        return self.source.select(self.spark, s.matchers, hints)

    def selector(self, s: Selector, timestamps: bool = False) -> Vector:
        at = self.at(s)
        if s.mode:
            raise UnsupportedError(f"the {s.mode} modifier on an instant vector selector")
        if at is not None:
            v = self.pinned(at).selector(replace(s, at=None), timestamps)
            return _named(self.repeat(v), v)
        offset = self.ms(s.offset)
        raw = self.raw(s, self.lookback, offset)
        v = select.instant(raw, self.grid, self.lookback, offset, timestamps)
        v.one_name = raw.one_name
        return v

    # range vectors

    def subquery(self, q: Subquery) -> Raw:
        """The inner expression at absolute multiples of the step, as raw samples."""
        step = self.ms(q.step) or self.default_step
        if step < 0:
            raise QueryError("subquery step must be positive")
        offset, width = self.ms(q.offset), self.width(q.range)
        first = self.grid.start - offset - width
        low = (first // step + 1) * step
        high = (self.grid.end - offset) // step * step
        if high < low:
            v = Vector(self.spark.createDataFrame([], "step_ms bigint, value double, drop_name boolean"), ())
        else:
            v = replace(self, grid=Grid(low, high, step), outer=self.outer or self.grid, instant=False, hint=("", ())).vector(q.expr)
        out, names = v.df, v.labels
        one = v.one_name or NAME not in names
        if NAME in names:  # a name that is to go does so here
            out = out.withColumn(col(NAME), F.when(F.col("drop_name"), "").otherwise(F.col(col(NAME))))
        return Raw(out.select(*columns(names), F.col("step_ms").alias("ts_ms"), "value", F.lit(False).alias("is_stale")), names, one)

    def range_function(self, e: Call) -> Vector:
        arg = next(a for a in map(unwrap, e.args) if isinstance(a, (Matrix, Subquery)))
        scalars = tuple(self.scalar(a) for a in e.args if type_of(a) == SCALAR)
        spec = arg.selector if isinstance(arg, Matrix) else arg
        at = self.at(spec)
        if at is not None:
            if e.name == "predict_linear":  # the samples are pinned, the time of the prediction moves
                return self.moving(e, arg, spec, at, scalars)
            inner = self.pinned(at)
            fixed = replace(spec, at=None)
            v = inner.range_function(Call(e.name, [a if unwrap(a) is not arg else Matrix(fixed, arg.range) if isinstance(arg, Matrix) else fixed for a in e.args]))
            return _named(self.repeat(v), v)
        offset, width = self.ms(spec.offset), self.width(arg.range)
        if isinstance(arg, Matrix) and spec.mode:
            raw = self.raw(spec, width + self.lookback, offset, e.name, self.lookback if spec.mode == "smoothed" else 0)
            return rangefn.extended(e.name, spec.mode, raw, self.grid, width, self.lookback, offset)
        raw = self.raw(spec, width, offset, e.name) if isinstance(arg, Matrix) else self.subquery(arg)
        v = rangefn.evaluate(e.name, raw, self.grid, width, offset, scalars, self.exact)
        v.one_name = raw.one_name
        return v

    def moving(self, e: Call, arg, spec, at: int, scalars) -> Vector:
        inner = self.pinned(at)
        fixed = replace(spec, at=None)
        zero, one = Number(0.0), Number(1.0)
        call = lambda x: inner.range_function(Call(e.name, [Matrix(fixed, arg.range) if isinstance(arg, Matrix) else fixed, x]))
        base, ahead = call(zero), call(one)
        slope = binary.vectors("-", ahead, base, False, binary.Matching())
        b, s = self.repeat(base), self.repeat(slope)
        df = scalars[0].attach(s.df).withColumn("value", F.col("value") * (scalars[0].expr + (F.col("step_ms") - at) / 1000.0))
        return binary.vectors("+", b, s.with_df(df.select(*s.df.columns)), False, binary.Matching())

    # calls

    def call(self, e: Call) -> Vector:
        name = e.name
        if name in NATIVE_HISTOGRAMS:
            # these are of native histograms only; float samples have none
            v = self.vector(e.args[0])
            return v.with_df(v.df.where(F.lit(False)).withColumn("drop_name", F.lit(True)))
        if name in ("absent", "absent_over_time"):
            return self.absent(e)
        if any(isinstance(unwrap(a), (Matrix, Subquery)) for a in e.args):
            return self.range_function(e)
        plain = replace(self, hint=("", ()))
        if name == "vector":
            return self.from_scalar(self.scalar(e.args[0]))
        if name == "timestamp" and isinstance(unwrap(e.args[0]), Selector):
            s = unwrap(e.args[0])
            v = self.selector(s, True)
            return _named(v.with_df(v.df, unique=v.unique and _one_name(v), nameless=True), v)
        if name in mathx.DATES and not e.args:
            v = self.from_scalar(Scalar(F.col("step_ms") / 1000.0))
            return self.mapped(v, mathx.DATES[name](F.col("value")))
        if name == "histogram_quantile":
            return labels.quantile(self.scalar(e.args[0]), plain.vector(e.args[1]))
        if name == "histogram_fraction":
            return labels.fraction(self.scalar(e.args[0]), self.scalar(e.args[1]), plain.vector(e.args[2]))
        if name == "histogram_quantiles":
            return self.quantiles(e)
        if name == "label_replace":
            return labels.replace(plain.vector(e.args[0]), *(unwrap(a).value for a in e.args[1:]))
        if name == "label_join":
            dst, sep, *src = (unwrap(a).value for a in e.args[1:])
            return labels.join(plain.vector(e.args[0]), dst, sep, src)
        if name == "info":
            return self.info(e)
        v = (self if name in ELEMENTWISE else plain).vector(e.args[0])
        x = F.col("value")
        if name in ELEMENTWISE:
            return self.mapped(v, ELEMENTWISE[name](x))
        if name == "timestamp":
            return self.mapped(v, F.col("step_ms") / 1000.0)
        if name in ("sort", "sort_desc"):
            return v if not self.instant else _named(v.with_df(v.df, order=[F.isnan(x), x.asc() if name == "sort" else x.desc()]), v)
        if name in ("sort_by_label", "sort_by_label_desc"):
            keys = [text.natural_key(v.label(unwrap(a).value)) for a in e.args[1:]] + [text.label_order(v)]
            return v if not self.instant else _named(v.with_df(v.df, order=[k.desc() if name.endswith("desc") else k.asc() for k in keys]), v)
        scalars = [self.scalar(a) for a in e.args[1:]]
        df = v.df
        for s in scalars:
            df = s.attach(df)
        v2 = v.with_df(df)
        if name == "round":
            return self.mapped(v2, mathx.round_to(x, scalars[0].expr) if scalars else mathx.floor(x + 0.5), v)
        if name == "clamp_min":
            return self.mapped(v2, mathx.clamp_min(x, scalars[0].expr), v)
        if name == "clamp_max":
            return self.mapped(v2, mathx.clamp_max(x, scalars[0].expr), v)
        if name == "clamp":
            low, high = scalars[0].expr, scalars[1].expr
            v2 = v2.with_df(df.where(~mathx.lt(high, low)))
            return self.mapped(v2, mathx.clamp_max(mathx.clamp_min(x, low), high), v)
        raise UnsupportedError(f"the {name} function")

    def mapped(self, v: Vector, value, base: Vector | None = None) -> Vector:
        base = base or v
        df = v.df.select(*columns(base.labels), "step_ms", value.cast("double").alias("value"), F.lit(True).alias("drop_name"))
        return _named(base.with_df(df, unique=base.unique and _one_name(base), order=[], nameless=True), base)

    def absent(self, e: Call) -> Vector:
        """1 at the steps without any series, with the labels that the selector's equalities fix."""
        arg = unwrap(e.args[0])
        v = self.range_function(Call("count_over_time", e.args)) if isinstance(arg, (Matrix, Subquery)) else self.vector(arg)
        s = arg.selector if isinstance(arg, Matrix) else arg
        fixed: dict[str, str | None] = {}
        if isinstance(s, Selector):
            for m in s.matchers:
                if m.name != NAME:
                    fixed[m.name] = m.value if m.op == "=" and m.name not in fixed else None
        names = tuple(sorted(k for k, x in fixed.items() if x))
        df = self.grid.frame(self.spark).join(v.df.select("step_ms").distinct(), "step_ms", "left_anti")
        return Vector(df.select(*(F.lit(fixed[n]).alias(col(n)) for n in names), "step_ms", F.lit(1.0).alias("value"), F.lit(False).alias("drop_name")), names, True)

    def quantiles(self, e: Call) -> Vector:
        v, label = self.vector(e.args[0]), unwrap(e.args[1]).value
        out = None
        for a in e.args[2:]:
            phi = self.scalar(a)
            q = labels.quantile(phi, v)
            shown = phi.constant if phi.constant is not None else float("nan")
            one = labels._set(q, label, F.lit(text.shortest(shown)))
            out = one if out is None else out.with_df(out.df.unionByName(one.df))
        return out

    def info(self, e: Call) -> Vector:
        v = self.vector(e.args[0])
        matchers = unwrap(e.args[1]).matchers if len(e.args) > 1 else []
        names = [m for m in matchers if m.name == NAME] or [Matcher(NAME, "=", "target_info")]
        data = [m for m in matchers if m.name != NAME]
        target = self.selector(Selector("", names + data))
        wanted = tuple(m.name for m in data) or None
        from .parser import _accepts_empty

        return labels.info(v, target, wanted, any(not _accepts_empty(m) for m in data))

    def matrix(self, e: Matrix | Subquery) -> DataFrame:
        """A range selector at the root of an instant query."""
        spec = e.selector if isinstance(e, Matrix) else e
        at = self.at(spec)
        if at is not None:
            fixed = replace(spec, at=None)
            return self.pinned(at).matrix(Matrix(fixed, e.range) if isinstance(e, Matrix) else fixed)
        offset, width = self.ms(spec.offset), self.width(e.range)
        raw = self.raw(spec, width, offset) if isinstance(e, Matrix) else self.subquery(e)
        return select.raw_range(raw, self.grid.start, width, offset)


def _one_name(v: Vector) -> bool:
    return v.one_name or NAME not in v.labels


def _named(v: Vector, like: Vector) -> Vector:
    v.one_name = like.one_name
    return v


__all__ = ["Planner", "Number", "Paren", "String"]
