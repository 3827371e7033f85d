"""Texts of numbers and keys of label sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Vector, col


def number_text(v: Column) -> Column:
    """Shortest decimal text of a double, without exponent where that is short."""
    plain = F.regexp_replace(F.format_string("%.0f", v), r"\A-0\z", "0")
    whole = (F.abs(v) < 1e15) & (v == F.round(v))
    return F.when(F.isnan(v), "NaN").when(v == float("inf"), "+Inf").when(v == float("-inf"), "-Inf").when(whole, plain).otherwise(F.regexp_replace(v.cast("string"), "E", "e"))


def shortest(x: float) -> str:
    """The shortest decimal text of a number, without exponent."""
    import numpy as np

    return {"nan": "NaN", "inf": "+Inf", "-inf": "-Inf"}.get(str(x)) or np.format_float_positional(x, trim="-")


def label_order(v: Vector) -> Column:
    """Orders label sets by name and value of the labels that are there, in order of names."""
    parts = [F.when(F.col(col(x)) != "", F.concat(F.lit(x + "\0\0"), F.col(col(x)), F.lit("\0\0"))).otherwise("") for x in v.labels]
    return F.concat(*parts) if parts else F.lit("")


def natural_key(text: Column) -> Column:
    """Key under which runs of digits compare as numbers: each run is written with its length before it."""
    runs = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), 1)

    def one(x: Column) -> Column:
        digits = F.regexp_replace(x, r"\A0+(?=\d)", "")
        return F.when(x.rlike(r"\A\d+\z"), F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 6, "0"), digits)).otherwise(F.concat(F.lit("1"), x))

    return F.array_join(F.transform(runs, one), "\0")
