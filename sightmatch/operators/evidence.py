"""From single sightings to candidate, confirmed and lost events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightmatch.functions import ordered
from sightmatch.params import EvidenceParams
from sightmatch.sources.scratch import cut

EVENT_COLUMNS = (
    "frame_id",
    "captured_ms",
    "state",
    "similarity",
    "quality",
    "evidence_count",
)


def event_keys(observations: DataFrame) -> list[str]:
    """What separates one evidence state from another."""
    optional = ("search_id", "threshold", "target_id")
    return [c for c in optional if c in observations.columns] + ["source_id", "track_id"]


def throttle(
    df: DataFrame,
    keys: list[str],
    order: str,
    time: str,
    gap_ms: int,
    size: int = ordered.SLICE_MS,
) -> DataFrame:
    """Only the rows at least gap_ms after the last one let through."""
    return ordered.thin(df, keys, order, time, {"_kept": gap_ms}, size).where("_kept").drop("_kept")


def run_every(frames: DataFrame, hz: float, size: int = ordered.SLICE_MS) -> DataFrame:
    """The frames on which a model with this rate runs (live cadence)."""
    return throttle(
        frames, ["source_id"], "frame_id", "captured_ms", cadence_ms(hz), size
    )


def cadence_ms(hz: float) -> int:
    # A whole number of ms at or above the interval decides like the interval itself.
    return -int(-1000.0 // max(hz, 0.1))


def thin_evidence(
    observations: DataFrame,
    params: EvidenceParams = EvidenceParams(),
    size: int = ordered.SLICE_MS,
) -> DataFrame:
    """Add `kept` (separated from the last kept one) and `evidence_count`, the kept rows of the
    sliding window up to and including the row."""
    keys = event_keys(observations)
    flagged = ordered.thin(
        observations, keys, "frame_id", "captured_ms", {"kept": params.separation_ms}, size
    )
    return window_count(flagged, keys, params, size)


def window_count(df: DataFrame, keys: list[str], params: EvidenceParams, size: int) -> DataFrame:
    """evidence_count by time slices; the end of a slice is repeated in front of the next one."""
    chunk = F.floor(F.col("captured_ms") / F.lit(size)).cast("bigint")
    edge = F.pmod(F.col("captured_ms"), F.lit(size)) >= size - params.window_ms
    slices = F.array_compact(F.array(chunk, F.when(edge & F.col("kept"), chunk + 1)))
    if params.window_ms > size:
        raise ValueError("a slice must be at least as long as the evidence window")
    recent = (
        Window.partitionBy(*keys, ordered.CHUNK)
        .orderBy("captured_ms")
        .rangeBetween(-params.window_ms, 0)
    )
    return (
        df.withColumn("_home", chunk)
        .withColumn(ordered.CHUNK, F.explode(slices))
        .withColumn("evidence_count", F.count_if("kept").over(recent))
        .where(F.col(ordered.CHUNK) == F.col("_home"))
        .drop("_home", ordered.CHUNK)
    )


def confirm(
    observations: DataFrame,
    frames: DataFrame,
    params: EvidenceParams = EvidenceParams(),
    threshold: float | None = None,
    size: int = ordered.SLICE_MS,
) -> DataFrame:
    """Events of every evidence state.

    `observations` are the accepted best faces per frame and track, scored: source_id,
    track_id, frame_id, captured_ms, similarity, quality and any of search_id, threshold,
    target_id.  `frames` is the log of all frames (source_id, frame_id, captured_ms), whose
    ticks stamp the losses.

    A hit is an observation at or above the threshold.  While the grace outlives window,
    separation and throttle, everything a hit does follows from four facts, each computed
    by (key, slice): is it kept as evidence, does the throttle let a candidate out, how much
    evidence lies in the window, and did a loss end the episode before it.
    """
    if not params.declarative:
        raise ValueError("needs 0 < separation <= window <= grace; see streaming.confirm_stream")
    keys = event_keys(observations)
    limit: Column = F.col("threshold") if "threshold" in keys else F.lit(threshold)
    seen = cut(
        observations.select(*keys, "frame_id", "captured_ms", "similarity", "quality")
    )
    single = ordered.one_chunk(seen, captured_ms=size, frame_id=ordered.SLICE_IDS)
    flagged = ordered.thin(
        seen.where(F.col("similarity") >= limit),
        keys,
        "frame_id",
        "captured_ms",
        {"kept": params.separation_ms, "emit": params.throttle_ms},
        size,
        link=("before_frame", "before_ms"),
        single=single["captured_ms"],
    )
    hits = cut(window_count(flagged, keys, params, size))
    ends = cut(_episode_ends(hits, frames, keys, params))
    starts = ends.where("next_frame IS NOT NULL").select(
        *keys, F.col("next_frame").alias("frame_id"), F.lit(True).alias("_starts")
    )
    over = ends.select(
        *keys, F.col("end_frame").alias("frame_id"), "tick_frame", "tick_ms", "due_ms"
    )
    at_frame = [*keys, "frame_id"]
    ready = F.when(F.col("evidence_count") >= params.required, F.col("frame_id"))
    told = ordered.newest(
        hits.join(starts, at_frame, "left").join(over, at_frame, "left"),
        keys,
        "frame_id",
        {"_start": F.when(F.col("_starts"), F.col("frame_id")), "_ready": ready},
        ordered.SLICE_IDS,
        before={"_ready_before": ready},
        single=single["frame_id"],
    )
    start = F.coalesce(F.col("_start"), F.lit(-1))
    still_open = F.col("_ready_before").isNull() | (F.col("_ready_before") < start)
    states = F.array_compact(
        F.array(
            F.when(still_open & F.col("emit"), F.lit("candidate")),
            F.when(
                still_open & (F.col("evidence_count") >= params.required), F.lit("confirmed")
            ),
            F.when(F.col("tick_frame").isNotNull() & (F.col("_ready") >= start), F.lit("lost")),
        )
    )
    events = cut(
        told.withColumn("state", F.explode(states)).select(
            *keys, *EVENT_COLUMNS, "kept", "tick_frame", "tick_ms", "due_ms"
        )
    )
    live = events.where("state <> 'lost'").select(*keys, *EVENT_COLUMNS)
    losses = _losses(events.where("state = 'lost'"), seen, keys, params)
    return cut(live.unionByName(losses))


def _episode_ends(
    hits: DataFrame, frames: DataFrame, keys: list[str], params: EvidenceParams
) -> DataFrame:
    """Hits that no other follows before a tick at or after their grace has run out.

    Only hits followed by a long gap, and the last ones, are looked up in the frame log.
    """
    long_gap = F.col("captured_ms") - F.col("before_ms") >= params.grace_ms
    inner = hits.where(long_gap).select(
        *keys,
        F.col("before_frame").alias("end_frame"),
        F.col("before_ms").alias("end_ms"),
        F.col("frame_id").alias("next_frame"),
    )
    last = hits.groupBy(*keys).agg(
        F.max("frame_id").alias("end_frame"),
        F.max("captured_ms").alias("end_ms"),
        F.lit(None).cast("bigint").alias("next_frame"),
    )
    waiting = inner.unionByName(last).withColumn("due_ms", F.col("end_ms") + params.grace_ms)
    ticks = frames.select(
        "source_id",
        "captured_ms",
        F.col("frame_id").alias("tick_frame"),
        F.col("captured_ms").alias("tick_ms"),
    )
    return ordered.next_at_or_after(
        waiting, ticks, ["source_id"], "due_ms", "captured_ms", ["tick_frame", "tick_ms"]
    ).where(
        F.col("tick_frame").isNotNull()
        & (F.col("next_frame").isNull() | (F.col("tick_frame") < F.col("next_frame")))
    )


def _losses(over: DataFrame, seen: DataFrame, keys: list[str], params: EvidenceParams) -> DataFrame:
    """The lost event of each confirmed episode, with what was seen last up to its tick."""
    left_over = (
        F.when(F.col("kept") & (F.col("tick_ms") == F.col("due_ms")), 1).otherwise(0)
        if params.grace_ms == params.window_ms
        else F.lit(0)
    )
    lost = over.select(
        *keys,
        F.col("tick_frame").alias("frame_id"),
        F.col("tick_ms").alias("captured_ms"),
        left_over.cast("bigint").alias("evidence_count"),
        (F.col("tick_frame") * 2 + 1).alias("_turn"),
    )
    views = seen.select(
        *keys, "similarity", "quality", (F.col("frame_id") * 2).alias("_turn")
    ).join(lost.select(*keys).distinct(), keys, "left_semi")
    return (
        ordered.newest(
            lost.unionByName(views, allowMissingColumns=True),
            keys,
            "_turn",
            {"_s": F.col("similarity"), "_q": F.col("quality")},
            ordered.SLICE_IDS,
        )
        .where("frame_id IS NOT NULL")
        .select(
            *keys,
            "frame_id",
            "captured_ms",
            F.lit("lost").alias("state"),
            F.col("_s").alias("similarity"),
            F.col("_q").alias("quality"),
            "evidence_count",
        )
    )


def with_track_box(events: DataFrame, tracks: DataFrame) -> DataFrame:
    """Add the track's last box at or before each event's frame."""
    keys = ["source_id", "track_id"]
    sides = ["x1", "y1", "x2", "y2"]
    moments = events.withColumn("_turn", F.col("frame_id") * 2 + 1)
    visible = tracks.select(
        *keys, (F.col("frame_id") * 2).alias("_turn"), F.struct(*sides).alias("_box")
    )
    # Events of several targets or thresholds can share a track and frame: fill each once.
    asked = moments.select(*keys, "_turn").distinct()
    filled = ordered.newest(
        asked.unionByName(visible, allowMissingColumns=True),
        keys,
        "_turn",
        {"bbox": F.col("_box")},
        ordered.SLICE_IDS,
    ).where("_turn % 2 = 1")
    return moments.join(filled.drop("_box"), [*keys, "_turn"], "left").drop("_turn")
