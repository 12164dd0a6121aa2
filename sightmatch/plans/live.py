"""Live search as two chained streams with a table between them.

Matching and association rank rows inside a frame, which a stream cannot do by itself, so the
first query runs the batch operators on each micro-batch and stores its sightings; the second
one folds the stored sightings into events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sightmatch import schemas
from sightmatch.operators import matching
from sightmatch.params import EvidenceParams
from sightmatch.plans.pipelines import sightings
from sightmatch.sources.readers import stream_frames
from sightmatch.sources.sinks import without_vectors, write_event_log
from sightmatch.streaming.queries import LATENESS, as_sightings, confirm_stream

# What a detector emits: one row per frame, with the faces it saw and the tracks it holds.
SEEN_FRAMES = (
    "search_id BIGINT, source_id BIGINT, frame_id BIGINT, captured_ms BIGINT,"
    " faces ARRAY<STRUCT<face_idx: BIGINT, x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE,"
    " quality: DOUBLE, accepted: BOOLEAN, embedding: ARRAY<FLOAT>>>,"
    " tracks ARRAY<STRUCT<track_id: BIGINT, x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>>"
)


def store_sightings(
    frames: DataFrame, targets: DataFrame, threshold: float, path: str, checkpoint: str
) -> StreamingQuery:
    """Match and place the faces of each micro-batch.  A batch that is run again overwrites its
    own folder, so every frame lands once."""

    def step(batch: DataFrame, batch_id: int) -> None:
        keys = ["search_id", "source_id", "frame_id", "captured_ms"]
        faces = batch.select(*keys, F.inline("faces"))
        tracks = batch.select("source_id", "frame_id", F.inline("tracks"))
        seen = sightings(faces, tracks, targets, threshold)
        rows = without_vectors(as_sightings(seen, batch))
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        # The vectors stay with the executors no longer than the batch.
        matching.forget_galleries()

    return (
        frames.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def store_events(
    spark,
    sightings_path: str,
    threshold: float,
    path: str,
    checkpoint: str,
    params: EvidenceParams = EvidenceParams(),
    lateness: str = LATENESS,
) -> StreamingQuery:
    """Fold the stored sightings into events, each search for itself; a found target is retired.
    Files may come in any order within the lateness."""
    stored = stream_frames(
        spark, f"{sightings_path}/batch=*", schemas.SIGHTINGS, files_per_trigger=1_000
    )
    events = confirm_stream(stored, threshold, params, lateness, retire=True)
    return write_event_log(events, path, checkpoint)
