"""Slots for the caller's vision models, run over decoded pictures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sightmatch.operators import quality
from sightmatch.operators.vectors import normalize_vectors, split_valid_vectors
from sightmatch.params import QualityProfile

_BOX = [T.StructField(s, T.DoubleType()) for s in ("x1", "y1", "x2", "y2")]
_POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
_FACE = [
    T.StructField("face_idx", T.LongType()),
    *_BOX,
    T.StructField("detection_score", T.DoubleType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("landmarks", T.ArrayType(_POINT)),
]
_CROP = [
    T.StructField("face_width", T.IntegerType()),
    T.StructField("face_height", T.IntegerType()),
    T.StructField("blur_variance", T.DoubleType()),
    T.StructField("brightness", T.DoubleType()),
]
_RAW = [
    T.StructField("anchor_idx", T.LongType()),
    *[T.StructField(n, T.DoubleType()) for n in ("cx", "cy", "w", "h", "obj", "cls0")],
]


def _run_model(
    images: DataFrame, keys: list[str], factory: Callable[[], Callable], fields: list
) -> DataFrame:
    """One output row per thing the model sees.  The factory is called once per task and
    returns a function from an (height, width, channels) BGR array to a list of dicts.  Pictures
    that could not be decoded (null) give no rows."""
    schema = T.StructType([*[images.schema[k] for k in keys], *fields])
    names = [f.name for f in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in batches:
            out = []
            for *key, height, width, channels, data in pdf.itertuples(index=False, name=None):
                if data is None:  # could not be decoded; its error_code stays with the photos
                    continue
                shape = (int(height), int(width), int(channels))
                pixels = np.frombuffer(data, np.uint8).reshape(shape)
                known = dict(zip(keys, key, strict=True))
                out += [known | seen for seen in model(pixels)]
            yield pd.DataFrame(out, columns=[*keys, *names])

    pictures = images.select(
        *keys,
        "image.height",
        "image.width",
        "image.nChannels",
        "image.data",
    )
    return pictures.mapInPandas(run, schema)


def _measured(model_factory: Callable[[], Callable]) -> Callable[[], Callable]:
    """A factory of the same model, whose faces have the numbers of their crops too."""

    def factory() -> Callable:
        model = model_factory()

        def measured(pixels: np.ndarray) -> list[dict]:
            names = [f.name for f in _CROP]
            return [
                face
                | dict(
                    zip(
                        names,
                        quality.crop_numbers(pixels, [face[s] for s in ("x1", "y1", "x2", "y2")]),
                        strict=True,
                    )
                )
                for face in model(pixels)
            ]

        return measured

    return factory


def infer_faces(
    images: DataFrame,
    keys: list[str],
    model_factory: Callable[[], Callable],
    profile: QualityProfile,
) -> DataFrame:
    """Faces of each picture, with unit vectors, quality and the gate's verdict.

    One pass: a picture is read once, and its crops are measured where the model sees it, so that pixels
    are neither shuffled nor joined."""
    raw = _run_model(images, keys, _measured(model_factory), [*_FACE, *_CROP])
    return assess_faces(raw, profile)


def assess_faces(raw: DataFrame, profile: QualityProfile) -> DataFrame:
    """The model's faces that have a usable vector, with unit vectors, quality and the gate's verdict."""
    valid, _ = split_valid_vectors(raw)
    posed = quality.add_pose(valid)
    gated = quality.gate_quality(posed, profile)
    return normalize_vectors(quality.score_quality(gated, profile))


def list_faces(
    images: DataFrame, kept: list[str], model_factory: Callable[[], Callable]
) -> DataFrame:
    """The columns `kept` of every picture, and the list `faces` of what infer_faces sees in it before it
    assesses them; empty where the picture is null.  So one pass serves who needs pictures without
    faces too."""
    face = T.StructType([*_FACE, *_CROP])
    names = face.names
    schema = T.StructType(
        [*[images.schema[k] for k in kept], T.StructField("faces", T.ArrayType(face))]
    )
    column = to_arrow_type(schema["faces"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _measured(model_factory)()
        for batch in batches:
            *_, height, width, channels, data = batch.columns
            faces = []
            for h, w, c, pixels in zip(height, width, channels, data, strict=True):
                if not pixels.is_valid:
                    faces.append([])
                    continue
                shape = (h.as_py(), w.as_py(), c.as_py())
                seen = model(np.frombuffer(pixels.as_buffer(), np.uint8).reshape(shape))
                faces.append([{n: _plain(f.get(n), n) for n in names} for f in seen])
            listed = pa.array(faces, column)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], listed], [*kept, "faces"]
            )

    pictures = images.select(*kept, "image.height", "image.width", "image.nChannels", "image.data")
    return pictures.mapInArrow(run, schema)


def _plain(value, name: str):
    """What a model gives as a field of a face in the form that Arrow takes: no arrays or numbers of numpy, null
    for a number that is none (as Pandas has it), points by their names."""
    if isinstance(value, np.ndarray | np.generic):
        value = value.tolist()
    if isinstance(value, float) and np.isnan(value):
        return None
    if name == "landmarks" and value is not None:
        return [p if isinstance(p, dict) else dict(zip(_POINT.names, p, strict=True)) for p in value]
    return value


def infer_detections(
    images: DataFrame, keys: list[str], model_factory: Callable[[], Callable]
) -> DataFrame:
    """Raw predictions of a person detector, ready for decode_predictions."""
    return _run_model(images, keys, model_factory, _RAW)
