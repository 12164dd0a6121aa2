"""Feature vectors: unit length and validity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightmatch.functions import vectors as v


def normalize_vectors(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Replace `col` by its unit vector (floats); null where it has none."""
    return df.withColumn(col, v.normalized(F.col(col)))


def split_valid_vectors(df: DataFrame, col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows with a usable vector, and the others.

    Observations drop the second part silently; for targets each of its rows is an error.
    """
    ok = v.is_valid(F.col(col))
    return df.where(ok), df.where(~ok)
