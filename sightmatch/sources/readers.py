"""Tables and files coming in."""

from __future__ import annotations

import os.path
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sightmatch import schemas
from sightmatch.functions import pictures, text
from sightmatch.sources import sums

#: Bytes of a file that one task may hold or hash at a time.
HASH_BYTES = 256 << 20
#: Pictures, and bytes of them, that one task reads where there are many.
TASK_FILES = 1024
TASK_BYTES = 128 << 20
# Fixed value: names that Hadoop takes for compressed files.
COMPRESSED = r"\.(gz|bz2|deflate|snappy|lz4|zst|lzo|lzo_deflate|passthrough)$"


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """The frame log of any number of sources."""
    return spark.read.schema(schemas.FRAMES).parquet(path)


def stream_frames(
    spark: SparkSession,
    path: str,
    schema: str | StructType = schemas.FRAMES,
    files_per_trigger: int = 64,
) -> DataFrame:
    """The same log (or another table, by its schema) as it grows."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def stream_topic(spark: SparkSession, servers: str, topic: str, schema: str) -> DataFrame:
    """JSON rows from a Kafka topic (needs Spark's Kafka package on the classpath)."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .load()
    )
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")


def read_photos(spark: SparkSession, path: str) -> DataFrame:
    """Pictures of a folder, decoded; error_code where that failed."""
    files = spark.read.format("binaryFile").load(path)
    # Spark plans each file as some MB, so that a task would get a few small ones only.
    index = files._jdf.queryExecution().analyzed().relation().location()
    tasks = max(
        index.allFiles().size() // TASK_FILES,
        index.sizeInBytes() // TASK_BYTES,
        4 * spark.sparkContext.defaultParallelism,
    )
    named = files.select(F.input_file_name().alias("path"), "content").coalesce(tasks)
    image = pictures.decoded(spark, F.col("path"), F.col("content"))
    decoded = named.select("path", image.alias("image"))
    failed = F.coalesce(F.col("image.height") <= 0, F.lit(True))
    return decoded.select(
        "path",
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
        F.when(~failed, F.col("image")).alias("image"),
        F.when(~failed, F.col("image.width")).alias("width"),
        F.when(~failed, F.col("image.height")).alias("height"),
        F.when(failed, F.lit("image_decode_failed")).alias("error_code"),
    )


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Length and SHA-256 of the files of a folder.  One of at most HASH_BYTES is held whole; longer ones are
    summed step by step (sums.sums_in_steps), when this is called.  Files named as compressed are held whole
    at any length, which Spark refuses above 2 GB."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    filename = F.regexp_extract("path", r"([^/]+)$", 1).alias("filename")
    long = [r["path"] for r in files.where(F.col("length") > HASH_BYTES).select("path").collect()]
    named = {p: re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in long}
    packed = [named[p] for p in long if re.search(COMPRESSED, p.lower())]
    in_steps = [named[p] for p in long if not re.search(COMPRESSED, p.lower())]
    held = files.where(F.col("length") <= HASH_BYTES) if long else files
    if packed:
        held = held.unionByName(spark.read.format("binaryFile").load(packed))
    summed = held.select(filename, "length", F.sha2("content", 256).alias("sha256"))
    if not in_steps:
        return summed
    sums.check_states()
    found = spark.createDataFrame(
        [(unquote(p), n, digest) for p, n, digest in sums.sums_in_steps(spark, in_steps, HASH_BYTES)],
        "path STRING, length BIGINT, sha256 STRING",
    )
    return summed.unionByName(found.select(filename, "length", "sha256"))


def audit_checksums(
    spark: SparkSession, path: str, expected: DataFrame, pattern: str = "*"
) -> DataFrame:
    """Each expected(filename, sha256) as ok, mismatch or missing."""
    found = read_files(spark, path, pattern).select("filename", F.col("sha256").alias("actual"))
    status = (
        F.when(F.col("actual").isNull(), F.lit("missing"))
        .when(F.col("actual").eqNullSafe(F.lower("sha256")), F.lit("ok"))
        .otherwise("mismatch")
    )
    return expected.join(found, "filename", "left").withColumn("status", status)


def _resolve(base: str, path: Column) -> Column:
    return F.when(path.startswith("/"), path).otherwise(
        F.when(path != "", F.concat(F.lit(base.rstrip("/") + "/"), path)).otherwise(path)
    )


def read_manifest(
    spark: SparkSession, path: str, *, lines: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Cases and their labelled intervals; relative paths start at the manifest's folder.

    One JSON document per file, or with `lines` any number of manifests, one per line, which
    Spark can split.
    """
    base = os.path.dirname(path)
    listed = (
        spark.read.schema(schemas.MANIFEST)
        .option("multiLine", not lines)
        .json(path)
        .select("version", F.posexplode("cases").alias("case_no", "c"))
    )
    cases = listed.select(
        "version",
        F.col("case_no").cast("bigint").alias("case_no"),
        F.col("c.id").alias("case_id"),
        _resolve(base, F.col("c.photo")).alias("photo"),
        _resolve(base, F.col("c.video")).alias("video"),
        text.strip(F.col("c.target_name")).alias("target_name"),
    )
    intervals = listed.select(
        F.col("c.id").alias("case_id"),
        F.posexplode("c.expected_intervals_seconds").alias("idx", "pair"),
    ).select(
        "case_id",
        F.col("idx").cast("bigint").alias("idx"),
        F.get("pair", F.lit(0)).alias("start_s"),
        F.get("pair", F.lit(1)).alias("end_s"),
        F.round(F.get("pair", F.lit(0)) * 1000).cast("bigint").alias("start_ms"),
        F.round(F.get("pair", F.lit(1)) * 1000).cast("bigint").alias("end_ms"),
    )
    return cases, intervals


def manifest_errors(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """What keeps manifests from being used: (file, case_id, error_code), one row per manifest that
    cannot be read (`unreadable_manifest`), has no cases (`no_cases`, also an empty file) or a version
    other than 1 (`unsupported_version`), and one per case with an interval that is not a pair
    (`interval_not_a_pair`).  Without rows, read_manifest holds every manifest below the path."""
    corrupt = "_corrupt"
    read = (
        spark.read.schema(f"{schemas.MANIFEST}, {corrupt} STRING")
        .option("multiLine", not lines)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", corrupt)
        .json(path)
        .select("version", "cases", corrupt, F.col("_metadata.file_path").alias("file"))
    )
    case_id = F.lit(None).cast("string").alias("case_id")
    n_cases = F.coalesce(F.size("cases"), F.lit(0))
    code = (
        F.when(F.col(corrupt).isNotNull(), F.lit("unreadable_manifest"))
        .when(n_cases <= 0, F.lit("no_cases"))
        .when(~F.col("version").eqNullSafe(1), F.lit("unsupported_version"))
    )
    whole = read.select("file", case_id, code.alias("error_code"))
    not_pair = F.exists(
        "c.expected_intervals_seconds", lambda i: F.coalesce(F.size(i), F.lit(-1)) != 2
    )
    pairs = read.where(F.col(corrupt).isNull()).select("file", F.explode("cases").alias("c"))
    single = pairs.where(not_pair).select(
        "file", F.col("c.id").alias("case_id"), F.lit("interval_not_a_pair").alias("error_code")
    )
    # Scans pass over files without a byte; the listing, which Spark keeps on the driver anyway, has them.
    plain = F.regexp_replace("file", "^([a-z0-9]+):/+", "$1:/")
    named = [(file,) for file in read.inputFiles()]
    empty = (
        spark.createDataFrame(named, "file STRING")
        .withColumn("_plain", plain)
        .join(read.select(plain.alias("_plain")), "_plain", "left_anti")
        .select("file", case_id, F.lit("no_cases").alias("error_code"))
    )
    return whole.where("error_code IS NOT NULL").unionByName(single).unionByName(empty)
