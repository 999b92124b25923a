"""Arithmetic and comparisons on doubles as IEEE 754 has them.

SQL raises on division by zero and sorts NaN above all numbers; array code expects infinities
and comparisons with NaN that are false. These expressions give the latter inside code
generation, on columns as well as inside ``transform`` and ``zip_with``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float | int


def as_column(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def divide(x: Number, y: Number) -> Column:
    x, y = as_column(x), as_column(y)
    by_zero = F.when(F.isnan(x) | (x == 0), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(y == 0, by_zero).otherwise(x / F.when(y == 0, F.lit(1.0)).otherwise(y))


def ordered(x: Column, y: Number) -> Column:
    """Neither is NaN."""
    return ~F.isnan(x) & ~F.isnan(as_column(y))


COMPARE: dict[str, Callable[[Column, Number], Column]] = {
    "<": lambda x, y: ordered(x, y) & (x < as_column(y)),
    ">": lambda x, y: ordered(x, y) & (x > as_column(y)),
    "<=": lambda x, y: ordered(x, y) & (x <= as_column(y)),
    ">=": lambda x, y: ordered(x, y) & (x >= as_column(y)),
    "==": lambda x, y: ordered(x, y) & (x == as_column(y)),
    "!=": lambda x, y: ~ordered(x, y) | (x != as_column(y)),
}

ARITHMETIC: dict[str, Callable[[Number, Number], Column]] = {
    "+": lambda x, y: as_column(x) + as_column(y),
    "-": lambda x, y: as_column(x) - as_column(y),
    "*": lambda x, y: as_column(x) * as_column(y),
    "/": divide,
}


def close(x: Column, y: Column, rel: float = 1e-9, abs_: float = 1e-12) -> Column:
    """Symmetric tolerance: equal, both NaN, or near by either measure."""
    return (x == y) | (F.isnan(x) & F.isnan(y)) | (F.abs(x - y) <= F.greatest(F.lit(abs_), F.lit(rel) * F.greatest(F.abs(x), F.abs(y))))


def number_text(x) -> str:
    """A number as JVM programs print it: ``5.0``, ``1.0E20``; whole types without a point."""
    if isinstance(x, (int, np.integer)):
        return str(int(x))
    if not np.isfinite(x):
        return "NaN" if np.isnan(x) else "Infinity" if x > 0 else "-Infinity"
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        return np.format_float_positional(x, unique=True, trim="0")
    mantissa, power = np.format_float_scientific(x, unique=True, trim="0").split("e")
    return f"{mantissa}E{int(power)}"
