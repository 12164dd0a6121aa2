"""Tables and files going out.  None of them takes vectors."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sightmatch.params import EvalCriteria

REPORT_VERSION = 1


def _vectors(kind: T.DataType, path: str) -> list[str]:
    """Places in a schema that are called embedding or hold arrays of single precision numbers."""
    if isinstance(kind, T.StructType):
        named = [f"{path}.{f.name}" for f in kind if f.name == "embedding"]
        return named + [p for f in kind for p in _vectors(f.dataType, f"{path}.{f.name}")]
    if isinstance(kind, T.ArrayType):
        own = [path] if isinstance(kind.elementType, T.FloatType) else []
        return own + _vectors(kind.elementType, f"{path}[]")
    if isinstance(kind, T.MapType):
        return _vectors(kind.keyType, f"{path}.key") + _vectors(kind.valueType, f"{path}.value")
    return []


def without_vectors(df: DataFrame) -> DataFrame:
    """df itself; an error if a vector is anywhere in it, however deeply nested."""
    found = _vectors(df.schema, "")
    if found:
        raise ValueError(f"vectors must not be written out: {', '.join(p.lstrip('.') for p in found)}")
    return df


def write_event_log(
    log: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append a stream of envelopes to a table; the checkpoint makes each row land once.  `trigger` is
    what DataStreamWriter.trigger takes, e.g. {"processingTime": "1 second"}; without it the query
    handles what is there and ends."""
    return (
        without_vectors(log)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )


def local_path(path: str) -> str | None:
    """The path on a mounted file system that a path or file: address names; None for others."""
    if re.match(r"file:/", path):
        return re.sub(r"^file:/+", "/", path)
    return None if re.match(r"[A-Za-z][\w+.-]*:", path) else path


def write_files(files: DataFrame, base: str) -> int:
    """Rows (path, data) as files below `base`, a folder that all executors see; how many there were.
    Tasks write the files themselves: Spark's writers make a folder per file, move each to its place when a
    task and again when the job ends.  A task that runs again writes the same files again."""
    root = local_path(base)
    if root is None:
        raise ValueError(f"{base} is on no mounted file system")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: set[str] = set()
        for batch in batches:
            for path, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                target = os.path.join(root, path)
                folder = os.path.dirname(target)
                if folder not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                # Under another name first, so that attempts at the same time leave a whole file.
                part = os.path.join(folder, f".{os.path.basename(target)}.{os.getpid()}")
                with open(part, "wb") as out:
                    out.write(data)
                os.replace(part, target)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    written = files.select("path", "data").mapInArrow(store, "n BIGINT")
    return written.agg(F.sum("n")).first()[0] or 0


def write_latest(
    payloads: DataFrame, key: str, seq: str, payload: str, checkpoint: str, path: str
) -> StreamingQuery:
    """Keep only the newest payload per key: each batch appends the keys it changed, under its
    batch number; read_latest picks the newest."""

    def store(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy(key).agg(
            F.max(seq).alias(seq), F.max_by(payload, seq).alias(payload)
        )
        newest.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        without_vectors(payloads)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def write_case_reports(
    metrics: DataFrame, events: DataFrame, path: str, *, folders: bool = False
) -> None:
    """A JSON report per case with one entry per threshold, and the events as JSON lines.

    Reports are lines too; with `folders` every case gets a folder of its own, which suits
    some hundred cases.  Events, of which there can be any number, are written row by row.
    """
    entry = F.struct(
        "threshold",
        "expected_intervals",
        "detected_intervals",
        "interval_recall",
        "false_confirmations",
        "negative_exposure_ms",
        "false_confirmations_per_hour",
        "latencies_ms",
    )
    reports = (
        without_vectors(metrics)
        .groupBy("case_id")
        .agg(F.array_sort(F.collect_list(entry)).alias("threshold_results"))
        .select(F.lit(REPORT_VERSION).alias("schema_version"), "case_id", "threshold_results")
    )
    for table, name in ((reports, "reports"), (without_vectors(events), "events")):
        if folders:
            by_case = table.withColumn("case", F.col("case_id")).repartition("case")
            writer = by_case.write.partitionBy("case")
        else:
            writer = table.write
        writer.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{name}")


def write_summary_report(
    aggregate: DataFrame,
    recommendation: DataFrame,
    path: str,
    criteria: EvalCriteria = EvalCriteria(),
) -> None:
    """The report over all cases: criteria, one entry per threshold, the recommendation."""
    entry = F.struct(*[c for c in aggregate.columns])
    listed = aggregate.agg(F.array_sort(F.collect_list(entry)).alias("aggregate"))
    report = listed.join(recommendation).select(  # one row on each side
        F.lit(REPORT_VERSION).alias("schema_version"),
        F.struct(
            F.lit(criteria.min_recall).alias("minimum_interval_recall"),
            F.lit(criteria.max_false_per_hour).alias("maximum_false_confirmations_per_hour"),
            F.lit(criteria.min_exposure_hours).alias("minimum_negative_exposure_hours"),
        ).alias("acceptance_criteria"),
        F.col("recommended_threshold").alias("recommended_similarity_threshold"),
        "status",
        "aggregate",
    )
    report.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/summary")
