"""How good a face crop is, and whether it may count."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightmatch.functions import boxes
from sightmatch.params import SEARCH, QualityProfile


def add_pose(faces: DataFrame, landmarks: str = "landmarks") -> DataFrame:
    """Roll in degrees and a yaw proxy from left eye, right eye and nose; null with fewer points."""
    points = F.col(landmarks)

    def at(i: int, axis: str) -> Column:
        return F.get(points, F.lit(i))[axis].cast("double")

    dx, dy = at(1, "x") - at(0, "x"), at(1, "y") - at(0, "y")
    spread = F.greatest(F.hypot(dx, dy), F.lit(1e-6))
    middle = (at(0, "x") + at(1, "x")) / 2.0
    seen = F.size(points) >= 3
    return faces.withColumns(
        {
            "roll_degrees": F.when(seen, F.degrees(F.atan2(dy, dx))),
            "yaw_proxy": F.when(seen, (at(2, "x") - middle) / (spread / 2.0)),
        }
    )


def measure(
    faces: DataFrame, width: Column | None = None, height: Column | None = None
) -> DataFrame:
    """Whole-pixel face size inside the frame; an empty crop has no blur and no brightness."""
    x1, y1, x2, y2 = boxes.box()
    sized = faces.withColumns(
        {
            "face_width": boxes.pixel_side(x1, x2, width),
            "face_height": boxes.pixel_side(y1, y2, height),
        }
    )
    empty = (F.col("face_width") == 0) | (F.col("face_height") == 0)
    return sized.withColumns(
        {
            "blur_variance": F.when(empty, 0.0).otherwise(F.col("blur_variance")),
            "brightness": F.when(empty, 0.0).otherwise(F.col("brightness")),
        }
    )


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("double")


def gate_quality(faces: DataFrame, profile: QualityProfile = SEARCH) -> DataFrame:
    """Add the ordered rejection reasons of a measured face, and `accepted` when there are none."""
    side = F.least("face_width", "face_height")
    empty = side == 0
    light = F.col("brightness")
    rules = [
        ("face_too_small", side < profile.min_side),
        ("detection_score_low", F.col("detection_score") < profile.min_detection),
        ("invalid_face_crop", empty),
        ("face_blurry", ~empty & (F.col("blur_variance") < profile.min_blur)),
        (
            "face_exposure_bad",
            ~empty & ((light < profile.min_brightness) | (light > profile.max_brightness)),
        ),
    ]
    if profile.max_roll is not None:
        rules.append(
            ("face_roll_too_large", F.abs(_optional(faces, "roll_degrees")) > profile.max_roll)
        )
    if profile.max_yaw is not None:
        rules.append(
            ("face_yaw_too_large", F.abs(_optional(faces, "yaw_proxy")) > profile.max_yaw)
        )
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))
    # From the rules, not from the array: a filter on it stays plain and moves to the scan.
    rejected = reduce(or_, [F.coalesce(bad, F.lit(False)) for _, bad in rules])
    return faces.withColumns({"rejection_reasons": reasons, "accepted": ~rejected})


def score_quality(faces: DataFrame, profile: QualityProfile = SEARCH) -> DataFrame:
    """Add `quality` in [0, 1] for a measured face."""
    side = F.least("face_width", "face_height").cast("double")
    size = F.least(F.lit(1.0), side / max(profile.min_side * 1.5, 1.0))
    blur = F.least(F.lit(1.0), F.col("blur_variance") / max(profile.min_blur * 2.0, 1.0))
    light = F.greatest(F.lit(0.0), 1.0 - F.abs(F.col("brightness") - 130.0) / 130.0)

    def posed(name: str, limit: float) -> Column:
        # greatest() skips nulls, so an unknown angle is set apart first.
        angle = _optional(faces, name)
        kept = F.greatest(F.lit(0.0), 1.0 - F.abs(angle) / limit)
        return F.when(angle.isNull(), 1.0).otherwise(kept)

    pose = posed("roll_degrees", 45.0) * posed("yaw_proxy", 1.0)
    total = (
        0.25 * F.col("detection_score") + 0.25 * size + 0.27 * blur + 0.15 * light + 0.08 * pose
    )
    return faces.withColumn("quality", boxes.clip01(total))


def assess(
    faces: DataFrame,
    profile: QualityProfile = SEARCH,
    width: Column | None = None,
    height: Column | None = None,
) -> DataFrame:
    """Measure, gate and score in one projection."""
    return score_quality(gate_quality(measure(faces, width, height), profile), profile)


def rejection_counts(faces: DataFrame, *by: str) -> DataFrame:
    """How often each reason occurred, sorted by reason."""
    return (
        faces.select(*by, F.explode("rejection_reasons").alias("reason"))
        .groupBy(*by, "reason")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(*by, "reason")
    )


def face_diagnostics(faces: DataFrame, *by: str) -> DataFrame:
    return faces.groupBy(*by).agg(
        F.count(F.lit(1)).alias("face_observations"),
        F.count_if("accepted").alias("accepted_faces"),
    )


# --- pixels ----------------------------------------------------------------------------

# Weights of blue, green and red in a gray level.
GRAY_BGR = (0.114, 0.587, 0.299)


def _crop_stats(gray: np.ndarray) -> tuple[float, float]:
    """Variance of the 4-neighbour Laplacian with mirrored borders, and the mean level."""
    edge = np.pad(gray, 1, mode="reflect") if min(gray.shape) > 1 else np.pad(gray, 1, mode="edge")
    if min(gray.shape) == 1 and max(gray.shape) > 1:
        # Mirror along the long side only; the short side has nothing to mirror.
        axis = int(np.argmax(gray.shape))
        long_pad = [(0, 0), (0, 0)]
        long_pad[axis] = (1, 1)
        short_pad = [(1, 1), (1, 1)]
        short_pad[axis] = (0, 0)
        edge = np.pad(np.pad(gray, long_pad, mode="reflect"), short_pad, mode="edge")
    centre = edge[1:-1, 1:-1]
    laplace = edge[:-2, 1:-1] + edge[2:, 1:-1] + edge[1:-1, :-2] + edge[1:-1, 2:] - 4.0 * centre
    return float(laplace.var()), float(gray.mean())


def crop_numbers(pixels: np.ndarray, box: tuple) -> tuple[int, int, float, float]:
    """Width, height, blur and brightness of a box cut to the picture; zeros where nothing is left."""
    x1, y1, x2, y2 = box
    h, w, c = pixels.shape
    left, top = max(0, int(x1)), max(0, int(y1))
    wide = max(0, min(w, int(x2)) - left)
    tall = max(0, min(h, int(y2)) - top)
    if not wide or not tall:
        return wide, tall, 0.0, 0.0
    crop = pixels[top : top + tall, left : left + wide].astype(float)
    gray = crop[..., 0] if c == 1 else np.rint(crop[..., :3] @ np.array(GRAY_BGR))
    return wide, tall, *_crop_stats(gray)


def crop_metrics(faces: DataFrame, images: DataFrame, on: list[str]) -> DataFrame:
    """Blur and brightness of every face crop, from decoded images.

    `images` holds one decoded picture per key in an `image` struct as Spark's image source
    gives it (height, width, nChannels, data in BGR order).  The join spreads by image, so
    the pixels of one picture meet only its own faces, a batch at a time.  Faces whose picture
    is missing or could not be decoded get nulls.
    """
    joined = faces.join(
        images.select(
            *on,
            F.col("image.height").alias("_h"),
            F.col("image.width").alias("_w"),
            F.col("image.nChannels").alias("_c"),
            F.col("image.data").alias("_data"),
        ),
        on,
        "left",
    )
    kept = [c for c in faces.columns if c not in ("blur_variance", "brightness")]
    schema = T.StructType(
        [faces.schema[c] for c in kept]
        + [
            T.StructField("face_width", T.IntegerType()),
            T.StructField("face_height", T.IntegerType()),
            T.StructField("blur_variance", T.DoubleType()),
            T.StructField("brightness", T.DoubleType()),
        ]
    )

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            stats = []
            boxes_ = pdf[["x1", "y1", "x2", "y2"]].to_numpy(dtype=float)
            for (x1, y1, x2, y2), h, w, c, data in zip(
                boxes_, pdf["_h"], pdf["_w"], pdf["_c"], pdf["_data"], strict=True
            ):
                if data is None:
                    stats.append((None, None, None, None))
                    continue
                pixels = np.frombuffer(data, np.uint8).reshape(int(h), int(w), int(c))
                stats.append(crop_numbers(pixels, (x1, y1, x2, y2)))
            out = pdf[kept].copy()
            names = ["face_width", "face_height", "blur_variance", "brightness"]
            found = pd.DataFrame(stats, columns=names, index=out.index, dtype="Float64")
            out[names] = found.astype({"face_width": "Int32", "face_height": "Int32"})
            yield out

    return joined.mapInPandas(look, schema)
