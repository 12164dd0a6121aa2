"""Which track does an observation belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightmatch.functions import boxes, ordered

FRAME = ["source_id", "frame_id"]

# A face counts for a person box only in this upper part of it.
UPPER_PART = 0.6


def associate_faces(faces: DataFrame, tracks: DataFrame) -> DataFrame:
    """The smallest track box of the frame holding the face centre in its upper part.

    Equal areas: the lowest track_id.  Faces inside no track drop out.  The join and the
    ranking share one partitioning by (source, frame).
    """
    t = tracks.select(
        *FRAME, "track_id", *[F.col(s).alias(f"track_{s}") for s in boxes.SIDES]
    )
    cx, cy = (F.col("x1") + F.col("x2")) / 2.0, (F.col("y1") + F.col("y2")) / 2.0
    tx1, ty1, tx2, ty2 = boxes.box("track_")
    inside = cx.between(tx1, tx2) & cy.between(ty1, ty1 + UPPER_PART * (ty2 - ty1))
    key = [c for c in ("search_id", "target_id", "threshold") if c in faces.columns]
    smallest = Window.partitionBy(*FRAME, *key, "face_idx").orderBy(
        boxes.area(tx1, ty1, tx2, ty2), "track_id"
    )
    return (
        faces.join(t, FRAME)
        .where(inside)
        .withColumn("_n", F.row_number().over(smallest))
        .where("_n = 1")
        .drop("_n")
    )


def best_face_per_track(associated: DataFrame, *per: str) -> DataFrame:
    """One accepted face per frame and track (and `per`): highest quality, then first."""
    best = Window.partitionBy(*FRAME, *per, "track_id").orderBy(
        F.col("quality").desc(), "face_idx"
    )
    if "accepted" in associated.columns:
        associated = associated.where("accepted")
    return associated.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def tracks_as_of(
    frames: DataFrame, tracks: DataFrame, ticks: DataFrame | None = None
) -> DataFrame:
    """Each frame with the tracks of the latest detector run at or before it.

    `ticks` lists the frames on which the detector ran; without it those that have tracks.
    """
    runs = (tracks if ticks is None else ticks).select(*FRAME).distinct()
    marked = frames.select(*FRAME, "captured_ms").join(
        runs.withColumn("_run", F.lit(True)), FRAME, "left"
    )
    placed = ordered.newest(
        marked,
        ["source_id"],
        "frame_id",
        {"tick_frame": F.when(F.col("_run"), F.col("frame_id"))},
        ordered.SLICE_IDS,
    ).drop("_run")
    seen = tracks.select(
        "source_id",
        F.col("frame_id").alias("tick_frame"),
        *[c for c in tracks.columns if c not in (*FRAME, "captured_ms")],
    )
    return placed.join(seen, ["source_id", "tick_frame"])
