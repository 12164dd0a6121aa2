"""The operators put together: enrolment, live search over tables, offline evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightmatch.operators import (
    admission,
    association,
    evaluation,
    evidence,
    eventlog,
    matching,
    models,
    searches,
)
from sightmatch.params import ENROLMENT, EvalCriteria, EvidenceParams, QualityProfile
from sightmatch.sources import gallery
from sightmatch.sources.scratch import cut


def enrolled(photos: DataFrame, faces: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """Targets, and the photos that gave none.

    All or nothing per search: one bad photo and the search has no targets.  Only the verdicts
    are written in between, never the vectors.
    """
    checked = admission.enroll(photos, faces, model)
    bad = cut(checked.where("error_code IS NOT NULL").drop("embedding"))
    good = checked.join(bad.select("search_id"), "search_id", "left_anti")
    return good, bad


def enroll_pictures(
    photos: DataFrame,
    model_factory: Callable[[], Callable],
    model: str,
    store: str,
    staging: str,
    profile: QualityProfile = ENROLMENT,
) -> DataFrame:
    """From uploaded pictures to stored targets; the verdict of every photo, without vectors.

    photos(search_id, photo_id, target_ord, name, content_type, length, image), photo_id unique.  A
    picture is read once: what the uploads say and the model's faces go to `staging`, an unused folder, and
    all else works on them.  All or nothing per search: where a photo is refused, none of its search's targets reach
    `store` (sources.gallery).  The staged faces are erased at the end.  After a failure before it, erase
    the folder and run again: a search that has targets in the store is not added a second time.
    """
    spark = photos.sparkSession
    sized = photos.withColumns(
        {"width": F.col("image.width"), "height": F.col("image.height")}
    )
    admitted = admission.admit_uploads(sized)
    told = ["search_id", "photo_id", "target_ord", "name", "error_code", "status"]
    # The model sees admitted pictures only; the others pass with their verdict.
    looked = admitted.select(
        *told, F.when(F.col("error_code").isNull(), F.col("image")).alias("image")
    )
    seen = models.list_faces(looked, told, model_factory)
    seen.write.parquet(staging)
    staged = spark.read.schema(seen.schema).parquet(staging)
    faces = models.assess_faces(staged.select("photo_id", F.inline("faces")), profile)
    refused = staged.select("photo_id", F.col("error_code").alias("_upload"), "status")
    named = staged.select("search_id", "photo_id", "target_ord", "name")
    checked = admission.enroll(named, faces, model).join(refused, "photo_id").withColumn(
        "error_code", F.coalesce("_upload", "error_code")
    )
    verdicts = cut(checked.drop("embedding", "_upload"))
    bad = verdicts.where("error_code IS NOT NULL").select("search_id").distinct()
    targets = (
        checked.join(bad, "search_id", "left_anti")
        .where("search_id IS NOT NULL")
        .withColumnRenamed("photo_id", "target_id")
        .select(*gallery.TARGET)
    )
    gallery.add_searches(targets, store)
    spark.createDataFrame([], seen.schema).write.mode("overwrite").parquet(staging)
    return verdicts


def sightings(
    faces: DataFrame,
    tracks: DataFrame,
    targets: DataFrame,
    threshold: float | None = None,
) -> DataFrame:
    """Best scored face per frame, track and target; with a threshold only matches to active
    targets (live search), without one every accepted face (evaluation)."""
    if threshold is None:
        scored = matching.match_target(faces, targets)
    else:
        scored = matching.match_gallery(faces, targets, threshold)
    per = ["search_id", "target_id"] if threshold is not None else ["search_id"]
    placed = association.associate_faces(scored, tracks)
    return association.best_face_per_track(placed, *per)


def live_search(
    faces: DataFrame,
    tracks: DataFrame,
    frames: DataFrame,
    targets: DataFrame,
    threshold: float,
    params: EvidenceParams = EvidenceParams(),
) -> DataFrame:
    """Events of running searches; a target is retired by the frame that confirms it."""
    seen = sightings(faces, tracks, targets, threshold)
    return searches.retire_found(evidence.confirm(seen, frames, params, threshold))


def event_history(events: DataFrame, keep: int) -> DataFrame:
    """Live events as numbered envelopes, the last `keep` of each search."""
    published = events.withColumn("type", F.col("state")).withColumn(
        "occurred_at", F.col("captured_ms")
    )
    log = eventlog.to_event_log(
        published,
        ["frame_id", "target_id", "track_id", "state"],
        ["target_id", "track_id", "state", "similarity", "quality", "evidence_count"],
    )
    return eventlog.retain_last(log, keep)


def evaluate(
    faces: DataFrame,
    tracks: DataFrame,
    frames: DataFrame,
    targets: DataFrame,
    cases: DataFrame,
    intervals: DataFrame,
    thresholds,
    criteria: EvalCriteria = EvalCriteria(),
    params: EvidenceParams = EvidenceParams(),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, case metrics and threshold metrics; a case is one search of one target.

    Faces are scored once and shared by all thresholds.
    """
    seen = sightings(faces, tracks, targets)
    events = evidence.confirm(matching.sweep(seen, thresholds), frames, params)
    confirmed = events.where("state = 'confirmed'").select(
        F.col("search_id").alias("case_id"), "threshold", "captured_ms"
    )
    per_case = evaluation.case_metrics(confirmed, intervals, cases, thresholds)
    return events, per_case, evaluation.threshold_metrics(per_case, criteria)
