"""Functions of range vectors.

Most functions first aggregate the samples that lie in the same windows (a cell), so a dense series is not multiplied by
window / step, and deal the cells to spans (runs of steps that see the same cells), so a sparse one is not either; steps
come last.  What a function needs from a neighbour (the sample before, for rates, resets and changes) is one `lag` by
series before that; whether the pair across two cells counts is seen in the window.  Where all values of a window are
needed (quantiles, smoothing) the state is their list.  Only regressions, deviations and exact sums deal the samples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import SMALL, inf, kahan_mean, kahan_sum, max_number, mean, nan, quantile_of, ranked
from ..model import Grid, Raw, Scalar, Vector, columns
from .select import by_series, in_windows, series_window, steps, window_start

KEEPS_NAME = {"last_over_time", "first_over_time"}


def _v() -> Column:
    return F.col("value")


def _ts() -> Column:
    return F.col("ts_ms")


def _last(x: str) -> Column:
    return F.max_by(x, "ts_ms")


def _cell(ts: Column, grid: Grid, width: int, offset: int) -> tuple[Column, Column]:
    """Numbers of the first and the last step whose windows hold a time."""
    first = F.greatest(grid.index(ts + offset), F.lit(0).cast("bigint"))
    return first, F.least(grid.index(ts + (offset + width)), F.lit(grid.count).cast("bigint")) - 1


def _spans(df: DataFrame, keys: list[str], grid: Grid, width: int) -> DataFrame:
    """Cells dealt to spans (k to until), runs of steps that see the same cells: a span begins where one comes or has gone."""
    if grid.count == 1 or width <= grid.step:  # a cell is of one step
        return df.withColumn("k", F.col("k0")).withColumn("until", F.col("k0"))
    reach = width // grid.step + 1
    near = Window.partitionBy(*keys).orderBy("k0").rangeBetween(-reach, reach)
    df = df.withColumn("come", F.collect_list("k0").over(near)).withColumn("gone", F.collect_list(F.col("k1") + 1).over(near))
    begin = F.filter(F.concat("come", "gone"), lambda k: (k >= F.col("k0")) & (k <= F.col("k1")))
    df = df.withColumn("begin", F.when(F.size("come") == 1, F.array("k0")).otherwise(F.sort_array(F.array_distinct(begin)))).drop("come", "gone")
    df = df.select("*", F.posexplode("begin").alias("at", "k"))
    return df.withColumn("until", F.coalesce(F.get("begin", F.col("at") + 1) - 1, F.col("k1"))).drop("begin", "at", "k0", "k1")


def _steps(df: DataFrame, grid: Grid) -> DataFrame:
    """Spans dealt to their steps."""
    return df.withColumn("at", F.explode(F.sequence("k", "until"))).withColumn("step_ms", F.col("at") * grid.step + grid.start).drop("at")


def _cells(raw: Raw, grid: Grid, width: int, offset: int, aggs: list[Column], merged: list[Column], paired: bool = False) -> DataFrame:
    """States of the samples that lie in the same windows, merged by span.

    ws is the start of the first window of a span; any other holds the same samples.
    paired: with the sample before (prev, prev_ts), and whether it is in the same cell (inner).
    """
    keys = columns(raw.labels)
    df = by_series(raw).where("not is_stale")
    if paired:
        w = series_window(raw)
        df = df.withColumn("prev", F.lag("value").over(w)).withColumn("prev_ts", F.lag("ts_ms").over(w))
    first, last = _cell(_ts(), grid, width, offset)
    df = df.withColumn("k0", first).withColumn("k1", last).where("k0 <= k1")
    if paired:
        first, last = _cell(F.col("prev_ts"), grid, width, offset)
        df = df.withColumn("inner", F.coalesce((first == F.col("k0")) & (last == F.col("k1")), F.lit(False)))
    df = _spans(df.groupBy(*keys, "k0", "k1").agg(*aggs), keys, grid, width)
    df = df.withColumn("ws", F.col("k") * grid.step + (grid.start - offset - width))
    return df.groupBy(*keys, "k", "until").agg(*merged)


MERGED = {"sum_over_time", "avg_over_time", "count_over_time", "min_over_time", "max_over_time", "last_over_time", "first_over_time", "present_over_time", "ts_of_first_over_time", "ts_of_last_over_time", "ts_of_max_over_time", "ts_of_min_over_time"}


def _merged(name: str) -> tuple[list[Column], Column]:
    """States of a cell, and the value of a window from its cells' states."""
    states, value = {
        "sum_over_time": ([F.sum(_v()).alias("s")], lambda: F.sum("s")),
        "avg_over_time": ([F.sum(_v()).alias("s"), F.sum(_v() * SMALL).alias("small"), F.count(_v()).alias("n")], lambda: mean(F.sum("s"), F.sum("small"), F.sum("n"))),
        "count_over_time": ([F.count(_v()).alias("n")], lambda: F.sum("n").cast("double")),
        "min_over_time": ([F.min(_v()).alias("m")], lambda: F.min("m")),
        "max_over_time": ([max_number(_v()).alias("m")], lambda: max_number(F.col("m"))),
        "last_over_time": ([_last("value").alias("v"), F.max(_ts()).alias("ts_ms")], lambda: F.max_by("v", "ts_ms")),
        "first_over_time": ([F.min_by("value", "ts_ms").alias("v"), F.min(_ts()).alias("ts_ms")], lambda: F.min_by("v", "ts_ms")),
        "present_over_time": ([F.count(_v()).alias("n")], lambda: F.min(F.lit(1.0))),
        "ts_of_first_over_time": ([F.min(_ts()).alias("t")], lambda: F.min("t") / 1000.0),
        "ts_of_last_over_time": ([F.max(_ts()).alias("t")], lambda: F.max("t") / 1000.0),
        "ts_of_max_over_time": ([F.max(F.struct(~F.isnan(_v()), _v().alias("value"), _ts().alias("t"))).alias("x")], lambda: F.max("x")["t"] / 1000.0),
        "ts_of_min_over_time": ([F.min(F.struct(_v().alias("value"), (-_ts()).alias("t"))).alias("x")], lambda: -F.min("x")["t"] / 1000.0),
    }[name]
    return states, value()


def _falls(a: Column, v: Column) -> Column:
    return (v < a) & ~F.isnan(a) & ~F.isnan(v)


def _reset() -> Column:
    return _falls(F.col("prev"), _v())


def _change() -> Column:
    return (_v() != F.col("prev")) & ~(F.isnan(_v()) & F.isnan("prev"))


def _over_pairs(amount: Column) -> list[Column]:
    """States of a sum over pairs of neighbours: within the cell, and the one pair that begins before it, with its time."""
    first = F.when(~F.col("inner") & F.col("prev_ts").isNotNull(), F.coalesce(amount, F.lit(0.0)))
    return [F.sum(F.when(F.col("inner"), F.coalesce(amount, F.lit(0.0))).otherwise(0.0)).alias("within"), F.max(first).alias("across"), F.min(F.when(first.isNotNull(), F.col("prev_ts"))).alias("across_ts")]


def _pairs_sum() -> Column:
    """The sum over the pairs that lie in a window."""
    return F.sum("within") + F.sum(F.when(F.col("across_ts") > F.col("ws"), F.col("across")).otherwise(0.0))


def _extrapolated(counter: bool, per_second: bool, width: int) -> tuple[list[Column], list[Column], Column]:
    """Rate of change between the first and the last sample, carried on towards the window's edges.

    Fixed values of the language: an edge 1.1 average gaps away or further counts as half a gap, and a counter is not
    carried below zero.
    """
    states = [F.count(_v()).alias("n"), F.min(_ts()).alias("t0"), F.max(_ts()).alias("tn"), F.min_by("value", "ts_ms").alias("v0"), _last("value").alias("vn")]
    merged = [F.sum("n").alias("n"), F.min_by("v0", "t0").alias("v0"), F.max_by("vn", "tn").alias("vn"), F.min("t0").alias("t0"), F.max("tn").alias("tn")]
    if counter:
        states += _over_pairs(F.when(_reset(), F.col("prev")))
        merged.append(_pairs_sum().alias("lost"))
    change = F.col("vn") - F.col("v0") + (F.col("lost") if counter else 0.0)
    to_start, to_end = (F.col("t0") - F.col("ws")) / 1000.0, (F.col("ws") + width - F.col("tn")) / 1000.0
    span = (F.col("tn") - F.col("t0")) / 1000.0
    gap = span / F.when(F.col("n") > 1, F.col("n") - 1).otherwise(1)
    near = F.when(to_start >= 1.1 * gap, gap / 2).otherwise(to_start)
    if counter:
        zero = F.when((change > 0) & ~F.isnan(change) & (F.col("v0") >= 0) & ~F.isnan("v0"), span * (F.col("v0") / F.when(change > 0, change).otherwise(1.0))).otherwise(near)
        near = F.least(near, zero)
    far = F.when(to_end >= 1.1 * gap, gap / 2).otherwise(to_end)
    factor = F.when(span != 0, (span + near + far) / F.when(span != 0, span).otherwise(1.0)).otherwise(1.0)
    if per_second:
        factor = factor / (width / 1000.0)
    return states, merged, F.when(F.col("n") > 1, change * factor)


def _instant(per_second: bool) -> tuple[list[Column], list[Column], Column]:
    """From the last two samples."""
    # one by one: a struct as a state would sort the samples
    states = [*(_last(x).alias(x) for x in ("value", "prev", "prev_ts")), F.max(_ts()).alias("tn")]
    merged = [*(F.max_by(x, "tn").alias(x) for x in ("value", "prev", "prev_ts")), F.max("tn").alias("ts_ms")]
    x = {n: F.col(n) for n in ("value", "prev", "ts_ms", "prev_ts")}
    two = x["prev_ts"] > F.col("ws")
    change = x["value"] - x["prev"]
    if not per_second:
        return states, merged, F.when(two, change)
    change = F.when((x["value"] < x["prev"]) & ~F.isnan(x["prev"]) & ~F.isnan(x["value"]), x["value"]).otherwise(change)
    gap = (x["ts_ms"] - x["prev_ts"]) / 1000.0
    return states, merged, F.when(two & (gap != 0), change / F.when(gap != 0, gap).otherwise(1.0))


PAIRED = {
    "rate": lambda width: _extrapolated(True, True, width),
    "increase": lambda width: _extrapolated(True, False, width),
    "delta": lambda width: _extrapolated(False, False, width),
    "irate": lambda width: _instant(True),
    "idelta": lambda width: _instant(False),
    "changes": lambda width: (_over_pairs(F.when(_change(), 1.0)), [_pairs_sum().alias("n")], F.col("n")),
    "resets": lambda width: (_over_pairs(F.when(_reset(), 1.0)), [_pairs_sum().alias("n")], F.col("n")),
}


def _regression(at: str) -> tuple[list[Column], dict[str, Column]]:
    """Least squares over seconds since `at`: slope and intercept; of equal values, exactly none and the value."""
    x = (_ts() - F.col(at)) / 1000.0
    aggs = [F.count(_v()).alias("n"), F.regr_slope(_v(), x).alias("slope"), F.regr_intercept(_v(), x).alias("intercept"), F.max(F.isnan(_v()) | (F.abs(_v()) == inf())).alias("odd"), F.min(_v()).alias("lo"), F.max(_v()).alias("hi")]
    flat = F.col("lo") == F.col("hi")
    return aggs, {"slope": F.when(flat, 0.0).otherwise(F.coalesce("slope", nan())), "intercept": F.when(flat, F.col("lo")).otherwise(F.coalesce("intercept", nan()))}


def _ordered_values() -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("ts_ms", "value"))), lambda x: x["value"])


def _smoothed(values: Column, sf: Column, tf: Column) -> Column:
    """Holt's linear smoothing: level and trend, from the first two values."""
    start = F.struct(F.get(values, 0).alias("s"), (F.get(values, 1) - F.get(values, 0)).alias("b"))

    def fold(a: Column, x: Column) -> Column:
        level = sf * x + (1.0 - sf) * (a["s"] + a["b"])
        trend = tf * (level - a["s"]) + (1.0 - tf) * a["b"]
        return F.struct(level.alias("s"), trend.alias("b"))

    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), start, fold, lambda a: a["s"])


def _exponential(sf: Scalar, tf: Scalar) -> tuple[Column, list[Column], Column, Column]:
    bad = (sf.expr <= 0) | (sf.expr >= 1) | (tf.expr <= 0) | (tf.expr >= 1)
    error = F.raise_error(F.lit("invalid smoothing or trend factor: expected a number between 0 and 1")).cast("double")
    two = F.size("vs") > 1
    value = F.when(bad, error).when(two, _smoothed(F.col("vs"), sf.expr, tf.expr))
    return F.struct("ts_ms", "value"), [F.transform(F.sort_array("vs"), lambda x: x["value"])], value, bad | two


def _deviations(ranked: Column) -> Column:
    middle = F.transform(F.array(quantile_of(F.lit(0.5), ranked)), lambda m: F.transform(ranked, lambda x: F.abs(x - m)))
    return F.get(middle, 0)


#: What is listed of a sample, what is made of the list one by one, the value, and which lists have one (None: all).
LISTED = {
    "quantile_over_time": lambda phi: (_v(), [ranked(F.col("vs"))], quantile_of(phi.expr, F.col("vs")), None),
    "mad_over_time": lambda: (_v(), [ranked(F.col("vs")), _deviations(F.col("vs")), ranked(F.col("vs"))], quantile_of(F.lit(0.5), F.col("vs")), None),
    "double_exponential_smoothing": _exponential,
}


def evaluate(name: str, raw: Raw, grid: Grid, width: int, offset: int = 0, args: tuple[Scalar, ...] = (), exact: bool = False) -> Vector:
    """A range function by name over windows of `width` ms; an empty window gives no sample."""
    keys = [*columns(raw.labels), "step_ms"]
    out = Vector(raw.df, raw.labels, raw.one_name or name in KEEPS_NAME, nameless=name not in KEEPS_NAME, size=raw.size)
    drop = F.lit(name not in KEEPS_NAME).alias("drop_name")

    def finish(df: DataFrame, value: Column) -> Vector:
        df = df.select(*keys, value.alias("value"), drop).where(F.col("value").isNotNull())
        return out.with_df(df)

    if name in MERGED and not (exact and name in ("sum_over_time", "avg_over_time")):
        states, value = _merged(name)
        return finish(_steps(_cells(raw, grid, width, offset, states, [value.alias("out")]), grid), F.col("out"))

    if name in PAIRED:
        states, merged, value = PAIRED[name](width)
        windows = _steps(_cells(raw, grid, width, offset, states, merged, name != "delta"), grid)
        return finish(windows.withColumn("ws", window_start(width, offset)), value)

    if name in LISTED:
        state, values, value, keep = LISTED[name](*args)
        spans = _cells(raw, grid, width, offset, [F.collect_list(state).alias("vs")], [F.flatten(F.collect_list("vs")).alias("vs")])
        same = all(a.constant is not None for a in args)  # at all steps
        if same and keep is not None:
            spans = spans.where(keep)
        for x in values:  # column by column, so that each is computed once
            spans = spans.withColumn("vs", x)
        if same:  # never null; a filter would compute it again
            return out.with_df(_steps(spans.withColumn("out", value), grid).select(*keys, F.col("out").alias("value"), drop))
        df = _steps(spans, grid)
        for a in args:
            df = a.attach(df)
        return finish(df, value)

    df = by_series(raw).where("not is_stale").select(*columns(raw.labels), "ts_ms", "value")
    df = in_windows(df, raw.labels, grid, width, offset, ["value"])
    df = df.withColumn("wstart", window_start(width, offset))
    groups = df.groupBy(*keys)
    if name in ("stddev_over_time", "stdvar_over_time"):
        aggs, value = [(F.stddev_pop if name.startswith("stddev") else F.var_pop)(_v()).alias("x")], F.col("x")
    elif name == "deriv":
        aggs, lines = _regression("wstart")
        value = F.when(F.col("n") > 1, F.when(F.col("odd"), nan()).otherwise(lines["slope"]))
    elif name == "predict_linear":
        aggs, lines = _regression("step_ms")
        df2 = args[0].attach(groups.agg(*aggs))
        return finish(df2, F.when(F.col("n") > 1, F.when(F.col("odd"), nan()).otherwise(lines["slope"] * args[0].expr + lines["intercept"])))
    elif name in ("sum_over_time", "avg_over_time"):
        aggs, value = [_ordered_values().alias("vs")], kahan_mean(F.col("vs")) if name[0] == "a" else kahan_sum(F.col("vs"))
    else:
        raise KeyError(name)
    return finish(groups.agg(*aggs), value)


def extended(name: str, mode: str, raw: Raw, grid: Grid, width: int, lookback: int, offset: int = 0) -> Vector:
    """Range functions of anchored and smoothed windows, whose values at both edges are taken, not carried on.

    anchored: the last sample at or before each edge (at the start else the first one in the window).
    smoothed: interpolated between the samples around each edge (else the nearest one).

    A sample is dealt to the steps whose windows hold it, and beyond to those whose start it is the last one before or whose
    end it is the first one after, `lookback` away at most.  Of these, of the first and of the last in a window there is one,
    so a window's state is a few numbers.
    """
    keys = [*columns(raw.labels), "step_ms"]
    after = lookback if mode == "smoothed" else 0
    counter = name in ("rate", "increase", "resets")
    add = {
        "changes": lambda a, v: F.when(v != a, 1.0).otherwise(0.0),
        "resets": lambda a, v: F.when(_falls(a, v), 1.0).otherwise(0.0),
        "delta": lambda a, v: v - a,
        "increase": lambda a, v: F.when(_falls(a, v), v).otherwise(v - a),
        "rate": lambda a, v: F.when(_falls(a, v), v).otherwise(v - a),
    }[name]

    w = Window.partitionBy(*columns(raw.labels)).orderBy("ts_ms", "value")
    df = by_series(raw).where("not is_stale").select(*columns(raw.labels), "ts_ms", "value")
    df = df.withColumn("prev", F.lag("value").over(w)).withColumn("prev_ts", F.lag("ts_ms").over(w)).withColumn("next_ts", F.lead("ts_ms").over(w))
    first = grid.index(F.greatest(_ts() - after, "prev_ts") + offset)
    behind = grid.index(F.least(_ts() + lookback, "next_ts") + (offset + width))
    df = steps(df, first, behind, grid, [*columns(raw.labels), "ts_ms", "value", "prev", "prev_ts", "next_ts"])
    start, end = F.col("step_ms") - (offset + width), F.col("step_ms") - offset
    inside = (_ts() > start) & (_ts() <= end)
    paired = F.coalesce(F.col("prev_ts") > start, F.lit(False))

    def only(where: Column, x: Column) -> Column:  # of the one row where it holds
        return F.max(F.when(where, x))

    low, high, lead, tail = _ts() <= start, _ts() > end, inside & ~paired, inside & F.coalesce(F.col("next_ts") > end, F.lit(True))
    states = [only(where, x).alias(k + mark) for k, where in (("low", low), ("lead", lead), ("tail", tail), ("high", high)) for mark, x in (("", _v()), ("_ts", _ts()))]
    df = df.groupBy(*keys).agg(*states, F.sum(F.when(inside & paired, add(F.col("prev"), _v()))).alias("pairs"))

    def edge(at: Column, low: str, high: str) -> Column:
        """The value at an edge by the last sample up to it and the first one beyond."""
        a, b, a_ts, b_ts = (F.col(x) for x in (low, high, low + "_ts", high + "_ts"))
        if mode == "anchored":
            return F.coalesce(a, b)
        base = F.when((b < a) & F.lit(counter), 0.0).otherwise(a)
        share = (at - a_ts) / F.when(b_ts > a_ts, b_ts - a_ts).otherwise(F.lit(1))
        return F.when(a_ts.isNull(), b).when(b_ts.isNull() | (a_ts == at), a).otherwise(base + (b - base) * share)

    some = F.col("lead_ts").isNotNull()
    if mode == "anchored":
        df = df.where(some)
    around = {f"{k}{mark}": F.coalesce(k + mark, other + mark) for k, other in (("lead", "high"), ("tail", "low")) for mark in ("", "_ts")}
    df = df.withColumns({"some": some, "in": F.col("lead"), "out": F.col("tail")}).withColumns(around)
    df = df.withColumn("first", edge(start, "low", "lead")).withColumn("last", edge(end, "tail", "high"))
    a, b = F.col("first"), F.col("last")
    value = add(a, a) + F.when(F.col("some"), add(a, F.col("in")) + F.coalesce("pairs", F.lit(0.0)) + add(F.col("out"), b)).otherwise(add(a, b))
    if name == "rate":
        value = value / (width / 1000.0)
    return Vector(df.select(*keys, value.alias("value"), F.lit(True).alias("drop_name")).where("value is not null"), raw.labels, raw.one_name, nameless=True, size=raw.size)
