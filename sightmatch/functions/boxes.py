"""Column expressions over boxes kept as four DOUBLE columns x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")


def side(low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), high - low)


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return side(x1, x2) * side(y1, y2)


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Overlap of two boxes; sides floored at 0, union floored at 1e-6."""
    overlap = area(
        F.greatest(a[0], b[0]),
        F.greatest(a[1], b[1]),
        F.least(a[2], b[2]),
        F.least(a[3], b[3]),
    )
    union = area(*a) + area(*b) - overlap
    return overlap / F.greatest(union, F.lit(1e-6))


def box(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(prefix + s) for s in SIDES)


def truncate(c: Column) -> Column:
    return c.cast("int")


def pixel_side(low: Column, high: Column, limit: Column | None) -> Column:
    """Whole-pixel extent after truncating toward zero and clamping to [0, limit]."""
    stop = truncate(high) if limit is None else F.least(limit.cast("int"), truncate(high))
    return F.greatest(F.lit(0), stop - F.greatest(F.lit(0), truncate(low)))


def clip01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
