"""Argument and result types of the functions of the language."""

from __future__ import annotations

from ..errors import QueryError
from ..plans.syntax import MATRIX, SCALAR, STRING, VECTOR

#: What follows the last type: it may be left out, or it may be left out and may be repeated.
OPTIONAL, REPEATED = "optional", "repeated"
#: Fixed values of the language: the types that each function takes.
SHAPES = {
    "abs": (VECTOR,),
    "absent": (VECTOR,),
    "absent_over_time": (MATRIX,),
    "acos": (VECTOR,),
    "acosh": (VECTOR,),
    "asin": (VECTOR,),
    "asinh": (VECTOR,),
    "atan": (VECTOR,),
    "atanh": (VECTOR,),
    "avg_over_time": (MATRIX,),
    "ceil": (VECTOR,),
    "changes": (MATRIX,),
    "clamp": (VECTOR, SCALAR, SCALAR),
    "clamp_max": (VECTOR, SCALAR),
    "clamp_min": (VECTOR, SCALAR),
    "cos": (VECTOR,),
    "cosh": (VECTOR,),
    "count_over_time": (MATRIX,),
    "day_of_month": (VECTOR, OPTIONAL),
    "day_of_week": (VECTOR, OPTIONAL),
    "day_of_year": (VECTOR, OPTIONAL),
    "days_in_month": (VECTOR, OPTIONAL),
    "deg": (VECTOR,),
    "delta": (MATRIX,),
    "deriv": (MATRIX,),
    "double_exponential_smoothing": (MATRIX, SCALAR, SCALAR),
    "end": (),
    "exp": (VECTOR,),
    "first_over_time": (MATRIX,),
    "floor": (VECTOR,),
    "histogram_avg": (VECTOR,),
    "histogram_count": (VECTOR,),
    "histogram_fraction": (SCALAR, SCALAR, VECTOR),
    "histogram_quantile": (SCALAR, VECTOR),
    "histogram_quantiles": (VECTOR, STRING, SCALAR, SCALAR, REPEATED),
    "histogram_stddev": (VECTOR,),
    "histogram_stdvar": (VECTOR,),
    "histogram_sum": (VECTOR,),
    "hour": (VECTOR, OPTIONAL),
    "idelta": (MATRIX,),
    "increase": (MATRIX,),
    "info": (VECTOR, VECTOR, OPTIONAL),
    "irate": (MATRIX,),
    "label_join": (VECTOR, STRING, STRING, STRING, REPEATED),
    "label_replace": (VECTOR, STRING, STRING, STRING, STRING),
    "last_over_time": (MATRIX,),
    "ln": (VECTOR,),
    "log10": (VECTOR,),
    "log2": (VECTOR,),
    "mad_over_time": (MATRIX,),
    "max_over_time": (MATRIX,),
    "min_over_time": (MATRIX,),
    "minute": (VECTOR, OPTIONAL),
    "month": (VECTOR, OPTIONAL),
    "pi": (),
    "predict_linear": (MATRIX, SCALAR),
    "present_over_time": (MATRIX,),
    "quantile_over_time": (SCALAR, MATRIX),
    "rad": (VECTOR,),
    "range": (),
    "rate": (MATRIX,),
    "resets": (MATRIX,),
    "round": (VECTOR, SCALAR, OPTIONAL),
    "scalar": (VECTOR,),
    "sgn": (VECTOR,),
    "sin": (VECTOR,),
    "sinh": (VECTOR,),
    "sort": (VECTOR,),
    "sort_by_label": (VECTOR, STRING, REPEATED),
    "sort_by_label_desc": (VECTOR, STRING, REPEATED),
    "sort_desc": (VECTOR,),
    "sqrt": (VECTOR,),
    "start": (),
    "stddev_over_time": (MATRIX,),
    "stdvar_over_time": (MATRIX,),
    "step": (),
    "sum_over_time": (MATRIX,),
    "tan": (VECTOR,),
    "tanh": (VECTOR,),
    "time": (),
    "timestamp": (VECTOR,),
    "ts_of_first_over_time": (MATRIX,),
    "ts_of_last_over_time": (MATRIX,),
    "ts_of_max_over_time": (MATRIX,),
    "ts_of_min_over_time": (MATRIX,),
    "vector": (SCALAR,),
    "year": (VECTOR, OPTIONAL),
}
SCALAR_RESULTS = {"end", "pi", "range", "start", "step", "time", "scalar"}
EXPERIMENTAL = {
    "double_exponential_smoothing",
    "end",
    "first_over_time",
    "histogram_quantiles",
    "info",
    "mad_over_time",
    "range",
    "sort_by_label",
    "sort_by_label_desc",
    "start",
    "step",
    "ts_of_first_over_time",
    "ts_of_last_over_time",
    "ts_of_max_over_time",
    "ts_of_min_over_time",
}
MOST_QUANTILES = 10


def result_type(name: str) -> str:
    return SCALAR if name in SCALAR_RESULTS else VECTOR


def check_call(name: str, given: list[str]) -> None:
    """Raises unless a function of that name takes arguments of these types."""
    shape = SHAPES.get(name)
    if shape is None:
        raise QueryError(f'unknown function with name "{name}"')
    tail = shape[-1] if shape and shape[-1] in (OPTIONAL, REPEATED) else ""
    shape = shape[:-1] if tail else shape
    least, most = len(shape) - bool(tail), len(shape)
    if tail == REPEATED:
        most = least + MOST_QUANTILES - 1 if name == "histogram_quantiles" else 1 << 30
    if not tail and len(given) != most:
        raise QueryError(f'expected {most} argument(s) in call to "{name}", got {len(given)}')
    if len(given) < least:
        raise QueryError(f'expected at least {least} argument(s) in call to "{name}", got {len(given)}')
    if len(given) > most:
        raise QueryError(f'expected at most {most} argument(s) in call to "{name}", got {len(given)}')
    for i, got in enumerate(given):
        want = shape[min(i, len(shape) - 1)]
        if got != want:
            raise QueryError(f'expected type {want} in call to function "{name}", got {got}')
