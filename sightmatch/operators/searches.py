"""Searches over their targets: lookups, rollups, ends, outages, erasure."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightmatch.functions import ordered, text
from sightmatch.operators.eventlog import last_per_key
from sightmatch.operators.matching import key_runs
from sightmatch.params import LATENCY_WINDOW, TERMINAL_STATUSES
from sightmatch.sources.scratch import cut

TARGET = ["search_id", "target_id"]

# The end of a search that goes on.
_FOREVER = 2**62


def _confirmed(events: DataFrame) -> DataFrame:
    return events.where(F.col("state") == "confirmed")


def unfound_targets(targets: DataFrame, events: DataFrame) -> DataFrame:
    """Targets of a search without a confirmation."""
    return targets.join(_confirmed(events).select(*TARGET), TARGET, "left_anti")


def check_targets(requests: DataFrame, targets: DataFrame) -> DataFrame:
    """Requests (request_id, target_id) naming a target that does not exist."""
    return requests.join(targets.select("target_id"), "target_id", "left_anti").withColumn(
        "error_code", F.lit("target_not_found")
    )


def lookup_requests(keys: DataFrame, searches: DataFrame) -> DataFrame:
    """The search a request id belongs to, ended ones included; null when there is none."""
    asked = keys.withColumn("_key", text.strip(F.col("request_id")))
    first = searches.where("request_id IS NOT NULL").groupBy(
        F.col("request_id").alias("_key")
    ).agg(F.min_by("search_id", "ord").alias("search_id"))
    return asked.join(first.where("_key != ''"), "_key", "left").drop("_key")


def dedupe_requests(requests: DataFrame) -> DataFrame:
    """Requests with the search that answers them: the first one of the same request id."""
    first = requests.where("request_id != ''").groupBy("request_id").agg(
        F.min_by("search_id", "ord").alias("_first")
    )
    return requests.join(first, "request_id", "left").withColumn(
        "search_id", F.coalesce(F.col("_first"), F.col("search_id"))
    ).drop("_first")


def names_a_request() -> Column:
    return F.coalesce(F.col("request_id") != "", F.lit(False))


def answer_requests(
    requests: DataFrame, ends: DataFrame, size: int = ordered.SLICE_MS
) -> DataFrame:
    """Requests (request_id, search_id, ord, at_ms) with the search that answers each: the active one of
    its request id, or else the one it would start itself.

    `ends` (search_id, ended_at) tells when a search ends once it has started; at that time it is
    active no more.  One that is not listed, or only with times up to its request, goes on.  Requests
    without an id each start their own.  Times must not be null; `ord` breaks their ties.

    Who starts a search is a chain through the requests of an id.  A request at which all searches that
    earlier ones could have started are over starts one in any case, so the chain is cut there and its
    parts are scanned on their own, jumping from start to start.
    """
    over = ends.select("search_id", F.col("ended_at").alias("_ended"))
    later = requests.select("search_id", "at_ms").join(over, "search_id").where("_ended > at_ms")
    until = later.groupBy("search_id", "at_ms").agg(F.min("_ended").alias("_until"))
    lived = (
        requests.where(names_a_request())
        .join(until, ["search_id", "at_ms"], "left")
        .withColumn("_until", F.coalesce("_until", F.lit(_FOREVER)))
    )
    key = ["request_id"]
    numbered = cut(ordered.number_rows(lived, key, ["at_ms", "ord"], "_n", size))
    reach = ordered.running_max(numbered, key, "_n", "_until", "_reach", ordered.SLICE_IDS)
    linked = ordered.previous(reach, key, "_n", {"_before": "_reach"}, ordered.SLICE_IDS)
    free = F.col("_before").isNull() | (F.col("at_ms") >= F.col("_before"))
    placed = ordered.newest(
        linked, key, "_n", {"_part": F.when(free, F.col("_n"))}, ordered.SLICE_IDS
    )
    part = [*key, "_part"]
    runs = (
        placed.select(*requests.columns, "_part", "_n", "_until")
        .repartition(*part)
        .sortWithinPartitions(*part, "_n")
    )
    names = requests.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, search, until = None, None, 0
        for batch in batches:
            for who, rows in key_runs(batch, part):
                times, over = (
                    rows.column(c).to_numpy(zero_copy_only=False) for c in ("at_ms", "_until")
                )
                own = rows.column("search_id")
                # Position 0 is the search that was active before these rows.
                known = pa.concat_arrays([pa.array([search], own.type), own])
                answers = np.zeros(len(times), np.int64)
                i = int(np.searchsorted(times, until)) if who == at else 0
                while i < len(times):
                    until, search = int(over[i]), own[i].as_py()
                    end = int(np.searchsorted(times, until))
                    answers[i:end] = i + 1
                    i = end
                at = who
                given = known.take(pa.array(answers))
                yield pa.RecordBatch.from_arrays(
                    [given if c == "search_id" else rows.column(c) for c in names], names
                )

    answered = runs.mapInArrow(scan, requests.schema)
    return answered.unionByName(requests.where(~names_a_request()))


def get_searches(ids: DataFrame, views: DataFrame) -> DataFrame:
    """Views by search id; unknown ids get an error code."""
    known = views.withColumn("_known", F.lit(True))
    return (
        ids.join(known, "search_id", "left")
        .withColumn("error_code", F.when(F.col("_known").isNull(), F.lit("search_not_found")))
        .drop("_known")
    )


def active_searches(views: DataFrame) -> DataFrame:
    return views.where(~F.col("status").isin(*TERMINAL_STATUSES))


def retire_found(events: DataFrame) -> DataFrame:
    """Events of a live search: nothing about a target after the time that first confirms it.

    Confirmations of several tracks at that time all stay.  Times compare over sources, frame
    numbers do not.
    """
    first = _confirmed(events).groupBy(*TARGET).agg(F.min("captured_ms").alias("_found"))
    return (
        events.join(first, TARGET, "left")
        .where(F.col("_found").isNull() | (F.col("captured_ms") <= F.col("_found")))
        .drop("_found")
    )


def target_found_events(retired: DataFrame) -> DataFrame:
    """One target_found per confirmation that retire_found keeps."""
    return _confirmed(retired).withColumn("state", F.lit("target_found"))


def best_similarity(events: DataFrame) -> DataFrame:
    """Highest similarity of any event per target."""
    return events.groupBy(*TARGET).agg(F.max("similarity").alias("best_similarity"))


def _per_target(targets: DataFrame, events: DataFrame) -> DataFrame:
    seen = events.groupBy(*TARGET).agg(
        F.max("similarity").alias("best_similarity"),
        F.max(F.when(F.col("state") == "confirmed", F.col("captured_ms"))).alias("found_at"),
    )
    return targets.join(seen, TARGET, "left").withColumn(
        "status", F.when(F.col("found_at").isNotNull(), F.lit("found")).otherwise("searching")
    )


def target_views(targets: DataFrame, events: DataFrame) -> DataFrame:
    """Status, time found and best similarity of every target."""
    return _per_target(targets, events).select(
        *TARGET, "target_ord", "name", "status", "found_at", "best_similarity"
    )


def search_view(searches: DataFrame, targets: DataFrame, events: DataFrame) -> DataFrame:
    """Each search with its targets in order, the counts and the ids still unfound."""
    entry = F.struct("target_ord", "target_id", "name", "status", "found_at", "best_similarity")
    per_search = (
        target_views(targets, events)
        .groupBy("search_id")
        .agg(
            F.array_sort(F.collect_list(entry)).alias("targets"),
            F.count_if(F.col("status") == "found").alias("found_count"),
            F.count(F.lit(1)).alias("total_count"),
        )
    )
    unfound = F.transform(
        F.filter("targets", lambda t: t["status"] != "found"), lambda t: t["target_id"]
    )
    return searches.join(per_search, "search_id", "left").withColumn(
        "unfound_target_ids", unfound
    )


def search_outcomes(searches: DataFrame, targets: DataFrame, events: DataFrame) -> DataFrame:
    """How each search(search_id, started_ms, timeout_ms, ended_ms) ends.

    A timeout is checked before a frame, so confirmations at or after it do not count.  A target
    is found by its first confirmation, and the last target found ends the search.
    `ended_ms` is the last frame of the log.  A search without targets is never complete.
    """
    due = F.col("started_ms") + F.col("timeout_ms")
    limits = searches.select("search_id", due.alias("_due"))
    in_time = (
        _confirmed(events)
        .join(limits, "search_id")
        .where(F.col("_due").isNull() | (F.col("captured_ms") < F.col("_due")))
    )
    found = in_time.groupBy(*TARGET).agg(F.min("captured_ms").alias("_found_at"))
    totals = (
        targets.join(found, TARGET, "left")
        .groupBy("search_id")
        .agg(
            F.count(F.lit(1)).alias("total_count"),
            F.count("_found_at").alias("found_count"),
            F.max("_found_at").alias("_last_found"),
            F.array_sort(
                F.collect_list(F.when(F.col("_found_at").isNull(), F.col("target_id")))
            ).alias("unfound_target_ids"),
        )
    )
    complete = F.coalesce(F.col("found_count") == F.col("total_count"), F.lit(False))
    late = F.col("ended_ms") >= due
    status = (
        F.when(complete, F.lit("completed"))
        .when(late, F.lit("timed_out"))
        .otherwise("stopped")
    )
    return searches.join(totals, "search_id", "left").select(
        "search_id",
        status.alias("status"),
        F.when(complete, F.lit("all_found"))
        .when(late, F.lit("search_timeout"))
        .alias("event_type"),
        F.when(complete, F.col("_last_found"))
        .when(late, due)
        .otherwise(F.col("ended_ms"))
        .alias("ended_at"),
        F.coalesce("found_count", F.lit(0)).alias("found_count"),
        F.coalesce("total_count", F.lit(0)).alias("total_count"),
        "unfound_target_ids",
    )


def terminal_events(outcomes: DataFrame, found: DataFrame) -> DataFrame:
    """What is published at the end: the status, each target_found, then how it came out.

    Columns (search_id, type, occurred_at, phase, ord, sub_ord, detail); number them by
    (occurred_at, phase, ord, sub_ord): found targets by time, then target order.
    """
    status = outcomes.select(
        "search_id",
        F.lit("search_status").alias("type"),
        F.col("ended_at").alias("occurred_at"),
        F.lit(1).alias("phase"),
        F.lit(0).cast("bigint").alias("ord"),
        F.lit(0).cast("bigint").alias("sub_ord"),
        F.col("status").alias("detail"),
    )
    ends = outcomes.select("search_id", F.col("ended_at").alias("occurred_at"))
    targets = found.join(ends, "search_id").select(
        "search_id",
        F.lit("target_found").alias("type"),
        "occurred_at",
        F.lit(2).alias("phase"),
        F.col("captured_ms").cast("bigint").alias("ord"),
        F.col("target_ord").cast("bigint").alias("sub_ord"),
        F.col("target_id").cast("string").alias("detail"),
    )
    final = outcomes.where("event_type IS NOT NULL").select(
        "search_id",
        F.col("event_type").alias("type"),
        F.col("ended_at").alias("occurred_at"),
        F.lit(3).alias("phase"),
        F.lit(0).cast("bigint").alias("ord"),
        F.lit(0).cast("bigint").alias("sub_ord"),
        F.when(
            F.col("event_type") == "search_timeout", F.array_join("unfound_target_ids", ",")
        ).alias("detail"),
    )
    return status.unionByName(targets).unionByName(final)


def track_states(states: DataFrame) -> DataFrame:
    """State shown per track when several targets claim it: confirmed wins, then the later
    target.  `states` has source_id, frame_id, track_id, target_ord, state, similarity."""
    rank = F.struct((F.col("state") == "confirmed").cast("int"), F.col("target_ord"))
    return (
        states.groupBy("source_id", "frame_id", "track_id")
        .agg(F.max(F.struct(rank.alias("r"), "state", "similarity")).alias("_s"))
        .select("source_id", "frame_id", "track_id", "_s.state", "_s.similarity")
    )


def search_metrics(frame_metrics: DataFrame, elapsed: DataFrame) -> DataFrame:
    """Frames per second over `elapsed(search_id, elapsed_ms)` and the 95th percentile of the
    last LATENCY_WINDOW latencies of frame_metrics(search_id, frame_id, latency_ms)."""
    frames = frame_metrics.groupBy("search_id").agg(F.count(F.lit(1)).alias("_n"))
    recent = (
        last_per_key(frame_metrics, ["search_id"], "frame_id", LATENCY_WINDOW)
        .groupBy("search_id")
        .agg(F.percentile("latency_ms", F.lit(0.95)).alias("_p95"))
    )
    seconds = F.greatest(F.col("elapsed_ms") / 1000.0, F.lit(1e-6))
    return (
        elapsed.join(frames, "search_id", "left")
        .join(recent, "search_id", "left")
        .select(
            "search_id",
            (F.coalesce("_n", F.lit(0)) / seconds).alias("processed_fps"),
            F.coalesce("_p95", F.lit(0.0)).alias("p95_latency_ms"),
        )
    )


def dropped_frames(frames: DataFrame) -> DataFrame:
    """Frames missing between the first and the last one of each source."""
    span = F.max("frame_id") - F.min("frame_id") + 1
    return frames.groupBy("source_id").agg(
        (span - F.count(F.lit(1))).alias("dropped_frames")
    )


def source_outages(
    frames: DataFrame, gap_ms: int, size: int = ordered.SLICE_IDS
) -> DataFrame:
    """One row per stretch of more than gap_ms without a frame."""
    return (
        ordered.previous(
            frames.select("source_id", "frame_id", "captured_ms"),
            ["source_id"],
            "frame_id",
            {"lost_ms": "captured_ms"},
            size,
        )
        .where(F.col("captured_ms") - F.col("lost_ms") > gap_ms)
        .select(
            "source_id",
            "frame_id",
            "lost_ms",
            F.col("captured_ms").alias("recovered_ms"),
        )
    )


def source_transitions(frames: DataFrame, gap_ms: int) -> DataFrame:
    """running on the first frame, source_lost once per outage, running on recovery."""
    first = frames.groupBy("source_id").agg(F.min("captured_ms").alias("at_ms"))
    outages = source_outages(frames, gap_ms)
    return (
        first.select("source_id", "at_ms", F.lit("running").alias("status"))
        .unionByName(
            outages.select(
                "source_id",
                (F.col("lost_ms") + gap_ms).alias("at_ms"),
                F.lit("source_lost").alias("status"),
            )
        )
        .unionByName(
            outages.select(
                "source_id",
                F.col("recovered_ms").alias("at_ms"),
                F.lit("running").alias("status"),
            )
        )
    )


def purge_targets(targets: DataFrame, ended: DataFrame) -> DataFrame:
    """The gallery without the vectors of ended searches."""
    return targets.join(ended.select("search_id"), "search_id", "left_anti")


def deletable(targets: DataFrame, active: DataFrame) -> DataFrame:
    """Targets with in_use, true where an active search still needs them."""
    used = active.select("search_id").distinct().withColumn("_used", F.lit(True))
    return (
        targets.join(used, "search_id", "left")
        .withColumn("in_use", F.coalesce("_used", F.lit(False)))
        .drop("_used")
    )
