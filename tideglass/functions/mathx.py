"""Column arithmetic with IEEE 754 results, which Spark's operators do not always give.

Spark raises or gives NULL for division by zero and logarithms of what is not positive, holds NaN equal to
itself and above all numbers, and rounds to integers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

def nan() -> Column:
    return F.lit(float("nan"))


def inf() -> Column:
    return F.lit(float("inf"))


def lit(x: float) -> Column:
    return F.lit(float(x))


def div(a: Column, b: Column) -> Column:
    return F.when(b == 0.0, a * F.pow(b, F.lit(-1.0))).otherwise(a / F.when(b == 0.0, 1.0).otherwise(b))


def mod(a: Column, b: Column) -> Column:
    return F.when(b == 0.0, nan()).otherwise(a % F.when(b == 0.0, 1.0).otherwise(b))


def floor(a: Column) -> Column:
    whole = F.isnan(a) | (F.abs(a) >= 4503599627370496.0) | (a == 0.0)
    return F.when(whole, a).otherwise(F.floor(F.when(whole, 1.0).otherwise(a)).cast("double"))


def ceil(a: Column) -> Column:
    return -floor(-a)


def _log(f):
    def run(a: Column) -> Column:
        return F.when(F.isnan(a), a).when(a == 0.0, -inf()).when(a < 0.0, nan()).otherwise(f(F.when(a > 0.0, a).otherwise(1.0)))

    return run


ln, log2, log10 = _log(F.log), _log(F.log2), _log(F.log10)


def asinh(a: Column) -> Column:
    return F.signum(a) * F.asinh(F.abs(a))


def eq(a: Column, b: Column) -> Column:
    return (a == b) & ~F.isnan(a)


def ne(a: Column, b: Column) -> Column:
    return (a != b) | F.isnan(a) | F.isnan(b)


def _ordered(op):
    def run(a: Column, b: Column) -> Column:
        return op(a, b) & ~F.isnan(a) & ~F.isnan(b)

    return run


lt, gt = _ordered(lambda a, b: a < b), _ordered(lambda a, b: a > b)
le, ge = _ordered(lambda a, b: a <= b), _ordered(lambda a, b: a >= b)

ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": div, "%": mod, "^": F.pow, "atan2": F.atan2}
COMPARISON = {"==": eq, "!=": ne, "<": lt, ">": gt, "<=": le, ">=": ge}


def clamp_min(a: Column, low: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(low), nan()).otherwise(F.greatest(a, low))


def clamp_max(a: Column, high: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(high), nan()).otherwise(F.least(a, high))


def round_to(a: Column, to: Column) -> Column:
    inverse = div(lit(1), to)
    return div(floor(a * inverse + 0.5), inverse)


#: Seconds of 400 years, after which days, months and weekdays come again.
CYCLE = 146_097 * 86_400


def _date(part, years: int = 0):
    def run(a: Column) -> Column:
        good = ~F.isnan(a) & (F.abs(a) < 2.0**63)
        seconds = F.when(good, a).otherwise(0.0).cast("bigint")
        inside = F.pmod(seconds, F.lit(CYCLE).cast("bigint"))
        cycles = F.call_function("div", seconds - inside, F.lit(CYCLE).cast("bigint"))
        return F.when(good, (part(F.timestamp_seconds(inside)) + cycles * years).cast("double")).otherwise(nan())

    return run


#: Of whole seconds since 1970 in UTC (the session's time zone must be UTC), however far from today; NaN of what is no such number.
DATES = {
    "minute": _date(F.minute), "hour": _date(F.hour), "day_of_week": _date(lambda t: F.dayofweek(t) - 1), "day_of_month": _date(F.dayofmonth),
    "day_of_year": _date(F.dayofyear), "days_in_month": _date(lambda t: F.dayofmonth(F.last_day(t))), "month": _date(F.month), "year": _date(F.year, 400),
}

ELEMENTWISE = {
    "abs": F.abs, "exp": F.exp, "sqrt": F.sqrt, "ceil": ceil, "floor": floor, "ln": ln, "log2": log2, "log10": log10, "sgn": F.signum,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "asinh": asinh, "acosh": F.acosh, "atanh": F.atanh,
    "deg": lambda a: a * 180.0 / math.pi, "rad": lambda a: a * math.pi / 180.0, **DATES,
}


def kahan_sum(values: Column) -> Column:
    """Compensated sum of an array of doubles, in its order; infinite once it is infinite."""
    zero = F.struct(lit(0).alias("s"), lit(0).alias("c"))

    def add(a: Column, v: Column) -> Column:
        t = a["s"] + v
        lost = F.when(F.abs(t) == inf(), 0.0).when(F.abs(a["s"]) >= F.abs(v), a["c"] + ((a["s"] - t) + v)).otherwise(a["c"] + ((v - t) + a["s"]))
        return F.struct(t.alias("s"), lost.alias("c"))

    return F.aggregate(values, zero, add, lambda a: F.when(F.abs(a["s"]) == inf(), a["s"]).otherwise(a["s"] + a["c"]))


#: Sums are taken of values by this power of two, too: exact, and finite for any number of finite doubles.
SMALL = 2.0**-64


def mean(total: Column, small: Column, n: Column) -> Column:
    """total / n, or from `small` (the sum of the values times SMALL) where the sum itself is beyond the doubles."""
    plain = ~F.isnan(total) & (F.abs(total) != inf())
    return F.when(plain, total / n).otherwise(small / n / SMALL)


def kahan_mean(values: Column) -> Column:
    return mean(kahan_sum(values), kahan_sum(F.transform(values, lambda x: x * SMALL)), F.size(values))


def max_number(v: Column) -> Column:
    """Aggregate: the greatest number; NaN only if there is nothing else."""
    return F.coalesce(F.max(F.when(~F.isnan(v), v)), nan())


def ranked(values: Column) -> Column:
    """The array in order, NaN being the smallest value."""
    up = F.sort_array(values)
    nans = F.concat(F.filter(up, lambda x: F.isnan(x)), F.filter(up, lambda x: ~F.isnan(x)))
    return F.when(F.isnan(F.get(up, F.size(values) - 1)), nans).otherwise(up)


def quantile_of(phi: Column, ordered: Column) -> Column:
    """Interpolated quantile of an array that is `ranked`."""
    n = F.size(ordered)
    inside = (phi >= 0) & (phi <= 1) & ~F.isnan(phi)
    rank = F.when(inside, phi).otherwise(0.0) * (n - 1)
    low = F.floor(rank).cast("int")
    high = F.least(low + 1, n - 1)
    w = rank - low
    value = F.get(ordered, low) * (1 - w) + F.get(ordered, high) * w
    return F.when(F.isnan(phi) | (n == 0), nan()).when(phi < 0, -inf()).when(phi > 1, inf()).otherwise(F.when(w == 0, F.get(ordered, low)).otherwise(value))


def quantile(phi: Column, values: Column) -> Column:
    """Interpolated quantile of an array, NaN being the smallest value."""
    return quantile_of(phi, ranked(values))
