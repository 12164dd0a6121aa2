"""Boxes to tracks: two-stage overlap association with constant-velocity prediction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightmatch.functions import boxes, ordered
from sightmatch.params import TrackerParams
from sightmatch.sources.scratch import cut

# A live track is a flat list: id, box (4), velocity (4), score, missed ticks.
Track = list

# Frames with more box pairs than this are compared by arrays.
_FEW_PAIRS = 300


def _overlaps(a: list, b: list, limit: float) -> list[tuple[float, int, int]]:
    """(-overlap, row, column) of the pairs that overlap by at least `limit`, in single precision,
    which decides ties and limits."""
    if len(a) * len(b) <= _FEW_PAIRS:
        # Rounding to single precision moves a number by less than this.
        near, out = limit * (1.0 - 1e-6), []
        for c, (bx1, by1, bx2, by2, _) in enumerate(b):
            other = (bx2 - bx1) * (by2 - by1)
            for r, (ax1, ay1, ax2, ay2) in enumerate(a):
                wide = (ax2 if ax2 < bx2 else bx2) - (ax1 if ax1 > bx1 else bx1)
                if wide > 0.0:
                    tall = (ay2 if ay2 < by2 else by2) - (ay1 if ay1 > by1 else by1)
                    if tall > 0.0:
                        shared = wide * tall
                        # Boxes that share something have sides above 0, unless one is not a number.
                        union = (ax2 - ax1) * (ay2 - ay1) + other - shared
                        iou = shared / (1e-6 if union < 1e-6 else union)
                        if iou >= near and (iou := float(np.float32(iou))) >= limit:
                            out.append((-iou, r, c))
        return out
    x, y = np.array(a, float)[:, :, None], np.array(b, float).T[None, :, :]
    wide = np.minimum(x[:, 2], y[:, 2]) - np.maximum(x[:, 0], y[:, 0])
    tall = np.minimum(x[:, 3], y[:, 3]) - np.maximum(x[:, 1], y[:, 1])
    shared = np.maximum(wide, 0.0) * np.maximum(tall, 0.0)

    def area(z: np.ndarray) -> np.ndarray:
        return np.maximum(z[:, 2] - z[:, 0], 0.0) * np.maximum(z[:, 3] - z[:, 1], 0.0)

    iou = (shared / np.maximum(area(x) + area(y) - shared, 1e-6)).astype(np.float32)
    rows, cols = np.nonzero((iou > 0) & (iou >= np.float32(limit)))
    return list(zip((-iou[rows, cols]).tolist(), rows.tolist(), cols.tolist(), strict=True))


def pair_up(a: list, b: list, min_iou: float) -> dict[int, int]:
    """Greedy one-to-one pairs by falling overlap; ties to the lowest row, then column."""
    pairs, taken = {}, set()
    for _, r, c in sorted(_overlaps(a, b, float(np.float32(min_iou)))):
        if r not in pairs and c not in taken:
            pairs[r] = c
            taken.add(c)
    return pairs


def advance(
    tracks: list[Track], found: list, next_id: int, params: TrackerParams
) -> tuple[list[Track], int]:
    """The tracks after one detector run; `found` has rows (x1, y1, x2, y2, score)."""
    moved = [
        [i, a + va, b + vb, c + vc, d + vd, va, vb, vc, vd, score, missed + 1]
        for i, a, b, c, d, va, vb, vc, vd, score, missed in tracks
    ]
    high, low = params.high, params.low
    strong = [f for f in found if f[4] >= high]
    weak = [f for f in found if low <= f[4] < high]
    waiting, fresh = moved, strong
    for seen, min_iou in ((strong, params.first_iou), (weak, params.second_iou)):
        pairs = pair_up([t[1:5] for t in waiting], seen, min_iou) if seen and waiting else {}
        for r, c in pairs.items():
            track_, (x1, y1, x2, y2, score) = waiting[r], seen[c]
            _, a, b, e, f = track_[:5]
            track_[1:] = [x1, y1, x2, y2, x1 - a, y1 - b, x2 - e, y2 - f, score, 0]
        if pairs:
            waiting = [t for r, t in enumerate(waiting) if r not in pairs]
        if seen is strong:
            used = set(pairs.values())
            fresh = [f for c, f in enumerate(strong) if c not in used]
    live = [t for t in moved if t[10] <= params.buffer]
    for x1, y1, x2, y2, score in fresh:
        live.append([next_id, x1, y1, x2, y2, 0.0, 0.0, 0.0, 0.0, score, 0])
        next_id += 1
    return live, next_id


def _segments(ticks: DataFrame, found: DataFrame, params: TrackerParams) -> DataFrame:
    """Ticks with the tick number their segment starts at.

    Once more than `buffer` ticks in a row were empty no track is left, so what follows does
    not depend on what came before: a source falls into segments there, without loss.
    """
    key = ["source_id", "frame_id"]
    busy = found.groupBy(*key).agg(F.lit(True).alias("_busy"))
    numbered = cut(
        ordered.number_rows(
            ticks.join(busy, key, "left"), ["source_id"], ["frame_id"], "tick", ordered.SLICE_IDS
        )
    )
    single = ordered.one_chunk(numbered, tick=ordered.SLICE_IDS)["tick"]

    def newest(df: DataFrame, **columns) -> DataFrame:
        return ordered.newest(
            df, ["source_id"], "tick", size=ordered.SLICE_IDS, single=single, **columns
        )

    mark = F.when(F.col("_busy"), F.col("tick"))
    linked = newest(numbered, values={}, before={"_before": mark})
    gap = F.col("_before").isNull() | (F.col("tick") - F.col("_before") > params.buffer + 1)
    start = F.when(F.col("_busy") & gap, F.col("tick"))
    return newest(linked, values={"segment": start}).where("segment IS NOT NULL")


TRACK_FIELDS = [
    T.StructField("track_id", T.LongType()),
    *[T.StructField(s, T.DoubleType()) for s in boxes.SIDES],
    T.StructField("score", T.DoubleType()),
    T.StructField("missed", T.IntegerType()),
]


def track_rows(key: tuple, tracks: list[Track]) -> list[tuple]:
    return [(*key, *t[:5], *t[9:]) for t in tracks]


def track(
    ticks: DataFrame, detections: DataFrame, params: TrackerParams = TrackerParams()
) -> DataFrame:
    """Every live track at every detector run, unmatched ones with their predicted box.

    `ticks` are the frames the detector ran on (source_id, frame_id, captured_ms), with or
    without detections.  Ids count from 1 per source in order of appearance.  Where no source
    has more ticks than a task takes (ordered.fits_a_task, which counts them once), sources are
    scanned whole, after one shuffle.  Longer ones are cut where they stay empty.  Either is a sorted
    stream in constant memory.  (A source that is never empty stays one sequential chain by the nature of
    the operator; streaming.track_stream runs it step by step with checkpointed state.)
    """
    found = detections.where(
        (F.col("score") >= params.low) & F.col("source_id").isNotNull() & F.col("frame_id").isNotNull()
    ).select("source_id", "frame_id", "det_idx", *boxes.SIDES, "score")
    log = ticks.select("source_id", "frame_id", "captured_ms")
    whole = ordered.fits_a_task(log, ["source_id"])
    part = ["source_id"] if whole else ["source_id", "segment"]
    if whole:
        placed = found
    else:
        log = _segments(log, found, params).drop("tick", "_busy", "_before")
        placed = found.join(log.select(*part, "frame_id"), ["source_id", "frame_id"])
    # A tick comes before what was found on it; what was found on no tick does not count.
    both = log.withColumn("_found", F.lit(False)).unionByName(
        placed.withColumn("_found", F.lit(True)), allowMissingColumns=True
    )
    key = Window.partitionBy(*part).orderBy("frame_id", "_found", "det_idx")
    rows = both.withColumn("_first", F.row_number().over(key) == 1)
    names = [*part, "frame_id", "captured_ms"]
    schema = T.StructType([*[log.schema[n] for n in names], *TRACK_FIELDS])
    out_types = _arrow(schema)
    sides = [*boxes.SIDES, "score"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live, next_id, tick, frame, found = [], 1, None, None, []
        for batch in batches:
            rows = []
            is_found = _values(batch.column("_found"))
            of_ticks = batch.filter(pc.invert(batch.column("_found")))
            keys = zip(*[_values(of_ticks.column(n)) for n in names], strict=True)
            for at, value, later, first in zip(
                _values(batch.column("frame_id")),
                zip(*[_values(batch.column(s)) for s in sides], strict=True),
                is_found,
                _values(batch.column("_first")),
                strict=True,
            ):
                if first or not later:
                    if tick is not None:
                        live, next_id = advance(live, found, next_id, params)
                        rows += track_rows(tick, live)
                    tick, found = None, []
                    if first:
                        live, next_id = [], 1
                if not later:
                    tick, frame = next(keys), at
                elif tick is not None and at == frame:
                    found.append(value)
            yield _batch(rows, out_types)
        if tick is not None:
            live, next_id = advance(live, found, next_id, params)
            yield _batch(track_rows(tick, live), out_types)

    local = rows.mapInArrow(scan, schema)
    if whole:
        return local
    local = cut(local)
    born = local.groupBy("source_id", "segment").agg(F.max("track_id").alias("_born"))
    earlier = (
        Window.partitionBy("source_id")
        .orderBy("segment")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = born.select(
        "source_id",
        "segment",
        F.coalesce(F.sum("_born").over(earlier), F.lit(0)).alias("_offset"),
    )
    return (
        local.join(offsets, ["source_id", "segment"])
        .withColumn("track_id", F.col("track_id") + F.col("_offset"))
        .drop("_offset", "segment")
    )


def _values(column: pa.Array) -> list:
    """The values as Python's own; a null number with a point is NaN.  Numbers go by way of numpy, which
    takes a tenth of the time."""
    if pa.types.is_floating(column.type) or not column.null_count and pa.types.is_primitive(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def box_motion(tracks: DataFrame) -> DataFrame:
    """How far each side of a track's box moved since its previous row; null on the first."""
    moved = ordered.previous(
        tracks,
        ["source_id", "track_id"],
        "frame_id",
        {f"_{s}": s for s in boxes.SIDES},
        ordered.SLICE_IDS,
    )
    return moved.withColumns(
        {f"d{s}": F.col(s) - F.col(f"_{s}") for s in boxes.SIDES}
    ).drop(*[f"_{s}" for s in boxes.SIDES])
