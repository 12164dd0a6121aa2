"""From raw detector predictions to boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightmatch.functions import boxes
from sightmatch.params import DetectorParams


def _levels(params: DetectorParams) -> list[tuple[int, int, int]]:
    """(first anchor, columns, stride) of each grid, in prediction order."""
    out, first = [], 0
    for stride in params.strides:
        rows, cols = params.input_h // stride, params.input_w // stride
        out.append((first, cols, stride))
        first += rows * cols
    return out


def anchor_count(params: DetectorParams) -> int:
    return sum((params.input_h // s) * (params.input_w // s) for s in params.strides)


def anchor_cell(idx: Column, params: DetectorParams) -> tuple[Column, Column, Column]:
    """Grid x, grid y and stride of an anchor, by arithmetic on its index (row-major)."""
    x = y = stride = None
    for first, cols, step in reversed(_levels(params)):
        local = idx - F.lit(first)
        here = (local % cols, F.floor(local / F.lit(cols)), F.lit(step).cast("bigint"))
        if stride is None:
            x, y, stride = here
        else:
            later = idx >= F.lit(first + cols * (params.input_h // step))
            x, y, stride = (
                F.when(later, old).otherwise(new)
                for old, new in zip((x, y, stride), here, strict=True)
            )
    return x, y, stride


def anchor_grid(spark: SparkSession, params: DetectorParams = DetectorParams()) -> DataFrame:
    x, y, stride = anchor_cell(F.col("id"), params)
    return spark.range(anchor_count(params)).select(
        F.col("id").alias("anchor_idx"),
        x.alias("grid_x"),
        y.alias("grid_y"),
        stride.alias("stride"),
    )


def letterbox_ratio(width: Column, height: Column, params: DetectorParams) -> Column:
    """Scale that fits a frame into the detector's input."""
    return F.least(F.lit(float(params.input_h)) / height, F.lit(float(params.input_w)) / width)


def add_letterbox(frames: DataFrame, params: DetectorParams = DetectorParams()) -> DataFrame:
    ratio = letterbox_ratio(F.col("width"), F.col("height"), params)
    return frames.withColumn("ratio", ratio).withColumns(
        {
            "scaled_w": (F.col("width") * F.col("ratio")).cast("int"),
            "scaled_h": (F.col("height") * F.col("ratio")).cast("int"),
        }
    )


def prediction_count_errors(
    preds: DataFrame, on: list[str], params: DetectorParams = DetectorParams()
) -> DataFrame:
    """Frames whose number of predictions is not the number of anchors."""
    expected = anchor_count(params)
    return (
        preds.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("n_predictions"))
        .where(F.col("n_predictions") != expected)
    )


def decode_predictions(
    preds: DataFrame,
    frames: DataFrame,
    on: list[str],
    params: DetectorParams = DetectorParams(),
) -> DataFrame:
    """Boxes in frame pixels of the predictions that score high enough.

    The anchor grid is arithmetic, so the only join is the one with the frame sizes.
    """
    scored = preds.withColumn("score", F.col("obj") * F.col("cls0")).where(
        F.col("score") >= params.min_score
    )
    gx, gy, stride = anchor_cell(F.col("anchor_idx"), params)
    sized = scored.join(frames.select(*on, "width", "height"), on)
    ratio = letterbox_ratio(F.col("width"), F.col("height"), params)
    cx, cy = (F.col("cx") + gx) * stride, (F.col("cy") + gy) * stride
    w, h = F.exp("w") * stride, F.exp("h") * stride
    return sized.select(
        *on,
        "anchor_idx",
        ((cx - w / 2.0) / ratio).alias("x1"),
        ((cy - h / 2.0) / ratio).alias("y1"),
        ((cx + w / 2.0) / ratio).alias("x2"),
        ((cy + h / 2.0) / ratio).alias("y2"),
        "score",
    )


def nms(
    detections: DataFrame,
    on: list[str],
    idx: str = "det_idx",
    max_iou: float = DetectorParams.max_iou,
) -> DataFrame:
    """Greedy suppression per frame: best score first, a box stays iff it overlaps no kept one
    by more than max_iou.  Equal scores: the later box first.

    A group is one frame, whose rows are bounded by the detector's number of anchors.
    """
    entry = F.struct(F.col("score"), F.col(idx), *[F.col(s) for s in boxes.SIDES])
    ranked = F.sort_array(F.collect_list(entry), asc=False)

    def sides(b: Column) -> tuple[Column, ...]:
        return tuple(b[s] for s in boxes.SIDES)

    def take(kept: Column, box: Column) -> Column:
        hidden = F.exists(kept, lambda k: boxes.iou(sides(k), sides(box)) > F.lit(max_iou))
        return F.when(hidden, kept).otherwise(F.array_append(kept, box))

    kept = F.aggregate("_ranked", F.filter("_ranked", lambda _: F.lit(False)), take)
    return (
        detections.groupBy(*on)
        .agg(ranked.alias("_ranked"))
        .select(*on, F.inline(kept))
    )


def iou_pairs(
    left: DataFrame, right: DataFrame, on: list[str], min_iou: float, left_id: str, right_id: str
) -> DataFrame:
    """Box pairs of the same frame that overlap by at least min_iou."""
    sides = boxes.SIDES
    a = left.select(*on, left_id, *[F.col(s).alias(f"_a_{s}") for s in sides])
    b = right.select(*on, right_id, *[F.col(s).alias(f"_b_{s}") for s in sides])
    overlap = boxes.iou(boxes.box("_a_"), boxes.box("_b_"))
    return (
        a.join(b, on)
        .withColumn("iou", overlap)
        .where(F.col("iou") >= min_iou)
        .select(*on, left_id, right_id, "iou")
    )


def normalize_boxes(df: DataFrame) -> DataFrame:
    """Box sides as fractions of the frame size, clipped to [0, 1]."""
    scale = {"x1": "width", "y1": "height", "x2": "width", "y2": "height"}
    return df.withColumns(
        {s: boxes.clip01(F.col(s) / F.col(by)) for s, by in scale.items()}
    )
