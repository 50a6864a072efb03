"""Rounding of doubles the way numpy/pandas ``round`` does it: ``rint(x * 10^d) / 10^d``.

``bround`` on a double rounds its shortest decimal text, which differs from pandas on exact
binary ties; multiply, ``rint`` (IEEE round-half-even) and divide are exactly specified
operations, so the result is the same bit pattern on every engine and partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: what counts as a number in text (no type suffix, no NaN, no infinity).
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def to_number(v: Column) -> Column:
    """Text as a double; anything that is not a finite number is null (``12d``, ``NaN``, ``Infinity``)."""
    t = F.trim(v.cast("string"))
    x = F.when(t.rlike(NUMBER_PATTERN), t).try_cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def round_half_even(x: Column, digits: int) -> Column:
    scale = float(10 ** digits)
    return F.rint(x.cast("double") * F.lit(scale)) / F.lit(scale)


def round_sql(expr: str, digits: int) -> str:
    scale = float(10 ** digits)
    return f"(round_even(CAST({expr} AS DOUBLE) * {scale!r}, 0) / {scale!r})"
