"""Sizes of the Arrow batches that texts travel in."""

from __future__ import annotations

from pyspark.sql import DataFrame

_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of one batch; both sides of the pipe hold some copies of it.
MOST_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, with the session's limit on the bytes of an Arrow batch lowered to MOST_BYTES."""
    df.sparkSession.conf.set(_BYTES, str(MOST_BYTES))
    return df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores added as it takes to differ from df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
