"""The stored gallery: reference vectors by search, and their erasure.

Vectors are biometric, so that ending a search has to remove them from the files and not only
from results.  Searches are dealt over a fixed number of folders by a hash; an erasure rewrites only
the folders that hold an ended search, and Spark removes their old files when the new ones are
committed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightmatch.operators import matching

# What a target is, as enrolment makes it.
TARGET = (
    "search_id", "target_id", "target_ord", "name", "face_width", "face_height", "detection_score",
    "quality_score", "model", "embedding",
)

FOLDERS = 64
FOLDER = "folder"
# Files of a folder at most, so that one large search is written by several tasks.
FILES = 16


def _dealt(df: DataFrame, folders: int) -> DataFrame:
    return df.withColumn(FOLDER, F.pmod(F.xxhash64("search_id"), F.lit(folders)).cast("int"))


def _by_folder(df: DataFrame):
    """A writer of df, a folder for each value of FOLDER."""
    spread = F.pmod(F.xxhash64("search_id", "target_id"), F.lit(FILES))
    return df.repartition(F.col(FOLDER), spread).write.partitionBy(FOLDER)


def add_targets(targets: DataFrame, path: str, folders: int = FOLDERS) -> None:
    """Add targets (search_id, target_id, …, embedding) to the store; without a search there is nothing
    that could ever erase them, so such rows are refused."""
    if not targets.where("search_id IS NULL").isEmpty():
        raise ValueError("targets without a search cannot be stored")
    _by_folder(_dealt(targets, folders)).mode("append").parquet(path)


def add_searches(targets: DataFrame, path: str, folders: int = FOLDERS) -> None:
    """add_targets without the searches that the store has already, so that a run can be repeated."""
    spark = targets.sparkSession
    try:
        known = stored_targets(spark, path, targets.schema).select("search_id").distinct()
        targets = targets.join(known, "search_id", "left_anti")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    add_targets(targets, path, folders)


def stored_targets(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The targets in the store; the schema is that of the tables added."""
    whole = T.StructType([*schema.fields, T.StructField(FOLDER, T.IntegerType())])
    return spark.read.schema(whole).parquet(path).where("search_id IS NOT NULL").drop(FOLDER)


def purge_store(
    spark: SparkSession, path: str, ended: DataFrame, schema: T.StructType, folders: int = FOLDERS
) -> None:
    """Erase the targets of ended searches (search_id) from the store and from the executors.

    Folders without an ended search are not read beyond their search ids.  A folder that would be left
    empty keeps one row without any values, since a folder without new rows is not replaced.  Folders
    are replaced one by one: after a failure some may still be as before, and another run finishes.
    """
    whole = T.StructType([*schema.fields, T.StructField(FOLDER, T.IntegerType())])
    stored = spark.read.schema(whole).parquet(path)
    gone = ended.select("search_id").where("search_id IS NOT NULL").distinct()
    # At most `folders` rows.
    touched = F.broadcast(
        stored.select(FOLDER, "search_id").join(gone, "search_id", "left_semi").select(FOLDER).distinct()
    )
    kept = stored.where("search_id IS NOT NULL").join(touched, FOLDER, "left_semi").join(
        gone, "search_id", "left_anti"
    )
    blank = touched.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema], FOLDER)
    rows = kept.select(*whole.names).unionByName(blank)
    _by_folder(rows).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    matching.forget_galleries()
