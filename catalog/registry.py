"""All queries by name: a function of (spark, sf_dir), and DuckDB text or None."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import admit, flows, history, scoring, vision

QUERIES = {
    **vision.QUERIES,
    **history.QUERIES,
    **admit.QUERIES,
    **scoring.QUERIES,
    **flows.QUERIES,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        history.confirm(spark, sf_dir)
        .groupBy("threshold", "state")
        .agg(F.count(F.lit(1)).alias("n_events"))
    )
