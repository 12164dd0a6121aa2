"""Measuring a threshold: labelled intervals against confirmations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightmatch.functions import ordered, text
from sightmatch.operators.admission import first_error
from sightmatch.params import DEFAULT_SIMILARITY, EvalCriteria, check_thresholds

HOUR_MS = 3_600_000.0
# Intervals are matched by minute: both sides meet on (case, minute), then on the exact times.
BUCKET_MS = 60_000

# Fixed value: the form of a case id.
CASE_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]*\z"


def decimate(frames: DataFrame, fps: float, hz: float) -> DataFrame:
    """Frames a model with rate hz sees in a recording: every n-th, n = fps/hz rounded half to
    even and at least 1."""
    step = F.greatest(F.lit(1), F.bround(F.lit(fps / hz)).cast("bigint"))
    return frames.where(F.col("frame_id") % step == 0)


def add_video_time(frames: DataFrame, fps: float) -> DataFrame:
    return frames.withColumn("timestamp_s", F.col("frame_id") / F.lit(max(fps, 1.0)))


def video_durations(frames: DataFrame, fps: float) -> DataFrame:
    return frames.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("frames"),
        (F.count(F.lit(1)) / F.lit(max(fps, 1.0))).alias("duration_s"),
    )


def validate_intervals(intervals: DataFrame, start: str = "start_ms", end: str = "end_ms"):
    """One row per broken interval(case_id, idx, start, end): not finite, before 0, empty, or
    before the end of the previous one in listed order."""
    linked = ordered.previous(
        intervals, ["case_id"], "idx", {"_end": end}, ordered.SLICE_IDS
    )
    s, e = F.col(start).cast("double"), F.col(end).cast("double")
    infinite = F.lit(float("inf"))
    odd = F.isnan(s) | F.isnan(e) | (F.abs(s) == infinite) | (F.abs(e) == infinite)
    error = first_error(
        (F.coalesce(odd | (s < 0) | (e <= s), F.lit(True)), "interval_invalid"),
        (s < F.col("_end").cast("double"), "intervals_not_sorted"),
    )
    return (
        linked.withColumn("error_code", error).where("error_code IS NOT NULL").drop("_end")
    )


def validate_manifest(cases: DataFrame, last_ends: DataFrame | None = None) -> DataFrame:
    """Cases with error_code.

    `cases` has version, case_id, target_name, photo, video and, where the length of the
    recording is known, duration_s and fps; `last_ends(case_id, last_end_s)` the end of the
    last listed interval.
    """
    copies = cases.groupBy("case_id").agg((F.count(F.lit(1)) > 1).alias("_twice"))
    checked = cases.join(copies, "case_id", "left")
    rules = [
        (F.coalesce(F.col("version") != 1, F.lit(True)), "invalid_version"),
        (F.coalesce(~F.col("case_id").rlike(CASE_ID), F.lit(True)), "invalid_case_id"),
        (F.col("_twice"), "duplicate_case_id"),
        (F.coalesce(text.strip(F.col("target_name")) == "", F.lit(True)), "missing_target_name"),
        (F.coalesce(F.col("photo") == "", F.lit(True)), "missing_photo"),
        (F.coalesce(F.col("video") == "", F.lit(True)), "missing_video"),
    ]
    if last_ends is not None:
        checked = checked.join(last_ends, "case_id", "left")
        frame = 1.0 / F.greatest(F.col("fps"), F.lit(1.0))
        rules.append(
            (F.col("last_end_s") > F.col("duration_s") + frame, "interval_after_end")
        )
    return checked.withColumn("error_code", first_error(*rules)).drop("_twice", "last_end_s")


def _minutes(intervals: DataFrame) -> DataFrame:
    span = F.sequence(
        F.floor(F.col("start_ms") / F.lit(BUCKET_MS)),
        F.floor((F.col("end_ms") - 1) / F.lit(BUCKET_MS)),
    )
    return intervals.select(
        "case_id", "idx", "start_ms", "end_ms", F.explode(span).alias("_minute")
    )


def _in_minutes(events: DataFrame) -> DataFrame:
    return events.withColumn("_minute", F.floor(F.col("captured_ms") / F.lit(BUCKET_MS)))


def events_in_intervals(confirmed: DataFrame, intervals: DataFrame) -> DataFrame:
    """Earliest confirmation inside each [start, end) that has one, per threshold, and its delay."""
    by = [c for c in ("threshold",) if c in confirmed.columns]
    inside = _in_minutes(confirmed).join(_minutes(intervals), ["case_id", "_minute"]).where(
        "captured_ms >= start_ms AND captured_ms < end_ms"
    )
    return (
        inside.groupBy("case_id", *by, "idx", "start_ms")
        .agg(F.min("captured_ms").alias("first_ms"), F.count(F.lit(1)).alias("n_inside"))
        .withColumn("latency_ms", F.col("first_ms") - F.col("start_ms"))
    )


def false_confirmations(confirmed: DataFrame, intervals: DataFrame) -> DataFrame:
    """Confirmations inside no interval of their case."""
    e = _in_minutes(confirmed).alias("e")
    i = _minutes(intervals).alias("i")
    hit = (
        (F.col("e.case_id") == F.col("i.case_id"))
        & (F.col("e._minute") == F.col("i._minute"))
        & (F.col("e.captured_ms") >= F.col("i.start_ms"))
        & (F.col("e.captured_ms") < F.col("i.end_ms"))
    )
    return e.join(i, hit, "left_anti").drop("_minute")


def confirmed_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("threshold").agg(
        F.count_if(F.col("state") == "confirmed").alias("confirmed_events")
    )


def case_metrics(
    confirmed: DataFrame, intervals: DataFrame, cases: DataFrame, thresholds
) -> DataFrame:
    """Recall, false confirmations and delays of every case under every threshold.

    `confirmed(case_id, threshold, captured_ms)`, valid `intervals`, `cases(case_id,
    duration_ms)`.  Valid intervals do not overlap, so a confirmation lies in at most one
    and the false ones are those left over.
    """
    values = check_thresholds(thresholds)
    expected = intervals.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("_expected"),
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("_inside_ms"),
    )
    grid = (
        cases.select("case_id", "duration_ms")
        .join(expected, "case_id", "left")
        .withColumn("threshold", F.explode(F.array(*[F.lit(v) for v in values])))
    )
    key = ["case_id", "threshold"]
    detected = (
        events_in_intervals(confirmed, intervals)
        .groupBy(*key)
        .agg(
            F.count(F.lit(1)).alias("_detected"),
            F.sum("n_inside").alias("_true"),
            F.array_sort(F.collect_list(F.struct("idx", "latency_ms"))).alias("_latencies"),
            F.sum("latency_ms").alias("_latency_ms"),
        )
    )
    totals = confirmed.groupBy(*key).agg(F.count(F.lit(1)).alias("_all"))
    joined = grid.join(detected, key, "left").join(totals, key, "left")

    def zero(name: str):
        return F.coalesce(F.col(name), F.lit(0))

    negative = F.greatest(F.lit(0), F.col("duration_ms") - zero("_inside_ms"))
    wrong = zero("_all") - zero("_true")
    return joined.select(
        *key,
        zero("_expected").alias("expected_intervals"),
        zero("_detected").alias("detected_intervals"),
        F.when(zero("_expected") > 0, zero("_detected") / zero("_expected")).alias(
            "interval_recall"
        ),
        wrong.alias("false_confirmations"),
        negative.alias("negative_exposure_ms"),
        F.when(negative > 0, wrong / (negative / F.lit(HOUR_MS))).alias(
            "false_confirmations_per_hour"
        ),
        F.coalesce(
            F.transform("_latencies", lambda x: x["latency_ms"]), F.array().cast("array<bigint>")
        ).alias("latencies_ms"),
        zero("_latency_ms").alias("latency_sum_ms"),
    )


def threshold_metrics(
    metrics: DataFrame, criteria: EvalCriteria = EvalCriteria()
) -> DataFrame:
    """Case metrics summed per threshold, and whether the threshold meets the criteria."""
    sums = metrics.groupBy("threshold").agg(
        F.sum("expected_intervals").alias("expected_intervals"),
        F.sum("detected_intervals").alias("detected_intervals"),
        F.sum("false_confirmations").alias("false_confirmations"),
        F.sum("negative_exposure_ms").alias("_negative"),
        F.sum("latency_sum_ms").alias("_latency"),
    )
    hours = F.col("_negative") / F.lit(HOUR_MS)
    expected, detected = F.col("expected_intervals"), F.col("detected_intervals")
    rated = sums.select(
        "threshold",
        "expected_intervals",
        "detected_intervals",
        F.when(expected > 0, detected / expected).alias("interval_recall"),
        "false_confirmations",
        hours.alias("negative_exposure_hours"),
        F.when(F.col("_negative") > 0, F.col("false_confirmations") / hours).alias(
            "false_confirmations_per_hour"
        ),
        F.when(detected > 0, F.col("_latency") / detected / F.lit(1000.0)).alias(
            "mean_confirmation_latency_s"
        ),
        (
            F.col("_negative").cast("double") >= F.lit(criteria.min_exposure_hours * HOUR_MS)
        ).alias("negative_exposure_sufficient"),
    )
    passed = (
        (F.col("interval_recall") >= criteria.min_recall)
        & (F.col("false_confirmations_per_hour") <= criteria.max_false_per_hour)
        & F.col("negative_exposure_sufficient")
    )
    return rated.withColumn("passed", F.coalesce(passed, F.lit(False)))


def recommend_threshold(metrics: DataFrame) -> DataFrame:
    """One row: the best passing threshold (null without one) and the status of the run."""
    rank = F.struct(
        -F.col("interval_recall"),
        F.col("false_confirmations_per_hour"),
        F.col("mean_confirmation_latency_s"),
        -F.col("threshold"),
    )
    best = metrics.where("passed").agg(
        F.min_by("threshold", rank).alias("recommended_threshold")
    )
    return best.withColumn(
        "status",
        F.when(F.col("recommended_threshold").isNotNull(), F.lit("passed")).otherwise(
            "failed_or_insufficient_data"
        ),
    )


def nearest_threshold(thresholds: DataFrame, default: float = DEFAULT_SIMILARITY) -> DataFrame:
    """The threshold(threshold, ord) nearest to the default; ties to the first listed."""
    rank = F.struct(F.abs(F.col("threshold") - default), F.col("ord"))
    return thresholds.agg(F.min_by("threshold", rank).alias("nearest_threshold"))
