"""Column expressions over feature vectors (ARRAY<FLOAT>), evaluated in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_NORM = 1e-12


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def norm(v: Column) -> Column:
    squares = F.aggregate(
        v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def _with_norm(v: Column, use) -> Column:
    """use(norm) with the norm bound once; written out inside a lambda it would be computed
    again for every element."""
    return F.get(F.transform(F.array(norm(v)), use), F.lit(0))


def _usable(length: Column) -> Column:
    # A null, NaN or infinite element makes the norm null, NaN or infinite.
    finite = ~F.isnan(length) & (length < F.lit(float("inf")))
    return F.coalesce(finite & (length > MIN_NORM), F.lit(False))


def is_valid(v: Column) -> Column:
    """Not empty, every element finite, magnitude above the zero limit."""
    return F.coalesce(_with_norm(v, _usable), F.lit(False))


def normalized(v: Column) -> Column:
    """Unit vector as floats; null where the vector is not valid."""

    def scaled(length: Column) -> Column:
        unit = F.transform(v, lambda x: (x.cast("double") / length).cast("float"))
        return F.when(_usable(length), unit)

    return _with_norm(v, scaled)
