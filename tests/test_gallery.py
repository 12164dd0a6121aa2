"""Erasing the vectors of ended searches from the store and from the executors."""

from __future__ import annotations

import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightmatch.operators import matching, models
from sightmatch.params import QualityProfile
from sightmatch.plans import pipelines
from sightmatch.sources import gallery

TARGETS = "search_id BIGINT, target_id BIGINT, target_ord INT, name STRING, embedding ARRAY<FLOAT>"


def targets_of(spark, searches, n=5):
    rng = random.Random(1)
    rows = [
        (s, 100 * s + k, k, f"name {s}", [rng.random() for _ in range(8)])
        for s in searches
        for k in range(n)
    ]
    return spark.createDataFrame(rows, TARGETS)


def files_with(path, searches):
    """Data files below path that hold a row of one of the searches, hidden ones included."""
    found = []
    for file in Path(path).rglob("*"):
        if file.is_file() and file.name.endswith(".parquet"):
            rows = pq.ParquetFile(file).read(columns=["search_id", "embedding"]).to_pylist()
            found += [file for r in rows if r["search_id"] in searches and r["embedding"]]
    return found


def ids(spark, path, schema):
    return sorted(tuple(r) for r in gallery.stored_targets(spark, path, schema).select("search_id", "target_id").collect())


def test_purge_leaves_no_file_with_a_vector(spark, tmp_path):
    path, searches = str(tmp_path / "gallery"), range(1, 13)
    targets = targets_of(spark, searches)
    gallery.add_targets(targets.where("search_id <= 6"), path, folders=4)
    gallery.add_targets(targets.where("search_id > 6"), path, folders=4)
    before = {str(f) for f in Path(path).rglob("*.parquet")}
    assert files_with(path, {3, 7})
    ended = spark.createDataFrame([(3,), (7,), (7,), (None,), (99,)], "search_id BIGINT")
    gallery.purge_store(spark, path, ended, targets.schema, folders=4)
    assert not files_with(path, {3, 7})
    left = [(s, 100 * s + k) for s in searches if s not in (3, 7) for k in range(5)]
    assert ids(spark, path, targets.schema) == left
    # Folders without an ended search keep their files.
    assert before & {str(f) for f in Path(path).rglob("*.parquet")}


def test_purge_of_everything_and_of_nothing(spark, tmp_path):
    path = str(tmp_path / "gallery")
    targets = targets_of(spark, [1, 2, 3])
    gallery.add_targets(targets, path, folders=2)
    none = spark.createDataFrame([], "search_id BIGINT")
    gallery.purge_store(spark, path, none, targets.schema, folders=2)
    assert len(ids(spark, path, targets.schema)) == 15
    for _ in range(2):
        gallery.purge_store(spark, path, targets, targets.schema, folders=2)
        assert ids(spark, path, targets.schema) == [] and not files_with(path, {1, 2, 3})
    gallery.add_targets(targets_of(spark, [4]), path, folders=2)
    assert len(ids(spark, path, targets.schema)) == 5


def test_targets_without_a_search_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="without a search"):
        gallery.add_targets(targets_of(spark, [1]).selectExpr(
            "CAST(NULL AS BIGINT) AS search_id", "target_id", "target_ord", "name", "embedding"
        ), str(tmp_path / "gallery"))


def test_purge_destroys_what_was_sent_to_executors(spark, tmp_path):
    path = str(tmp_path / "gallery")
    targets = targets_of(spark, [1, 2])
    gallery.add_targets(targets, path)
    faces = targets.selectExpr(
        "search_id", "1L AS source_id", "target_id AS frame_id", "0L AS face_idx", "embedding"
    )
    stored = gallery.stored_targets(spark, path, targets.schema)
    found = matching.best_target(faces, stored, broadcast=True)
    assert found.count() == 10 and matching._SHIPPED
    sent = list(matching._SHIPPED)
    gallery.purge_store(spark, path, targets.where("search_id = 1"), targets.schema)
    assert not matching._SHIPPED
    for broadcast in sent:
        with pytest.raises(Exception, match="destroyed|[Nn]o such file"):
            broadcast.unpersist()
            broadcast.value
    again = matching.best_target(faces, gallery.stored_targets(spark, path, targets.schema), broadcast=True)
    assert {r.search_id for r in again.collect()} == {2}


# --- enrolment of pictures ------------------------------------------------------------------

UPLOADS = (
    "search_id BIGINT, photo_id BIGINT, target_ord INT, name STRING, content_type STRING, length BIGINT,"
    " image STRUCT<height: INT, width: INT, nChannels: INT, data: BINARY>"
)
PROFILE = QualityProfile(min_side=8, min_blur=5.0, min_detection=0.6)


def a_model(calls):
    def factory():
        def model(pixels):
            with open(calls, "a") as log:
                log.write("x")
            h, w, _ = pixels.shape
            n = int(pixels[0, 0, 0]) % 3
            return [
                {"face_idx": k, "x1": 0.0, "y1": 0.0, "x2": float(w), "y2": float(h), "detection_score": 0.9,
                 "embedding": [3.0, 4.0], "landmarks": None}
                for k in range(n)
            ]

        return model

    return factory


def uploads_of(spark, pictures):
    rng = np.random.default_rng(2)
    rows = []
    for search, photo, faces, kind in pictures:
        image = None
        if faces is not None:
            pixels = rng.integers(60, 180, (10, 12, 3), dtype=np.uint8)
            pixels[0, 0, 0] = 60 + faces
            image = (10, 12, 3, bytearray(pixels.tobytes()))
        rows.append((search, photo, photo, f" name {photo} ", kind, 100, image))
    return spark.createDataFrame(rows, UPLOADS)


def test_pictures_are_read_once_and_searches_stored_whole(spark, tmp_path):
    png = "image/png"
    pictures = [(1, 1, 1, png), (1, 2, 1, png), (2, 3, 1, png), (2, 4, 0, png), (3, 5, 1, png), (3, 6, None, png),
                (4, 7, 2, png), (5, 8, 1, "image/gif"), (6, 9, 1, png)]
    photos = uploads_of(spark, pictures)
    store, staging, calls = (str(tmp_path / n) for n in ("store", "staging", "calls"))
    verdicts = pipelines.enroll_pictures(photos, a_model(calls), "m", store, staging, PROFILE)
    told = {r.photo_id: r.error_code for r in verdicts.collect()}
    assert told == {1: None, 2: None, 3: None, 4: "no_face", 5: None, 6: "image_decode_failed",
                    7: "multiple_faces", 8: "unsupported_media_type", 9: None}
    assert "embedding" not in verdicts.columns
    # The model saw each admitted picture once, and no face is left in the staging folder.
    assert len(Path(calls).read_text()) == 7
    assert not any(f.stat().st_size and pq.ParquetFile(f).metadata.num_rows for f in Path(staging).rglob("*.parquet"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("search_id", "target_id")])
    assert ids(spark, store, schema) == [(1, 1), (1, 2), (6, 9)]
    # A second run adds nothing twice.
    pipelines.enroll_pictures(photos, a_model(calls), "m", store, str(tmp_path / "again"), PROFILE)
    assert ids(spark, store, schema) == [(1, 1), (1, 2), (6, 9)]


def test_uploads_are_read_once(spark, tmp_path):
    png = "image/png"
    pictures = [(1, 1, 1, png), (1, 2, 0, png), (2, 3, 1, png), (3, 4, None, png), (None, 5, 1, png), (5, 6, 1, "image/gif")]
    path, reads = str(tmp_path / "photos"), str(tmp_path / "reads")
    uploads_of(spark, pictures).write.parquet(path)
    uploads = spark.read.parquet(path)

    def look(batches):
        for batch in batches:
            with open(reads, "a") as log:
                log.write("x" * batch.num_rows)
            yield batch

    store, staging = str(tmp_path / "store"), str(tmp_path / "staging")
    verdicts = pipelines.enroll_pictures(
        uploads.mapInArrow(look, uploads.schema), a_model("/dev/null"), "m", store, staging, PROFILE
    )
    told = {r.photo_id: (r.search_id, r.name, r.error_code, r.status) for r in verdicts.collect()}
    assert told == {
        1: (1, "name 1", None, None),
        2: (1, "name 2", "no_face", None),
        3: (2, "name 3", None, None),
        4: (3, "name 4", "image_decode_failed", 422),
        5: (None, "name 5", None, None),
        6: (5, "name 6", "unsupported_media_type", 415),
    }
    assert len(Path(reads).read_text()) == len(pictures)


def test_listed_faces_are_those_of_one_row_each(spark):
    """Numbers and arrays of numpy, numbers that are none, points without names, and keys no double holds."""

    def factory():
        def model(pixels):
            h, w, _ = pixels.shape
            box = {"x1": np.float32(0), "y1": 0.0, "x2": float(w), "y2": np.float64(h)}
            points = [(2.0, 2.0), (6.0, 2.0), (4.0, 5.0)]
            return [
                box | {"face_idx": 0, "detection_score": np.float32(0.75), "embedding": np.array([3.0, 4.0]),
                       "landmarks": [dict(zip("xy", p, strict=True)) for p in points]},
                box | {"face_idx": np.int64(1), "detection_score": float("nan"), "embedding": [0.0, 0.0], "landmarks": None},
                box | {"face_idx": 2, "detection_score": float("nan"), "embedding": np.array([1, 1], np.float32),
                       "landmarks": None},
            ][: int(pixels[0, 0, 0]) % 4]

        return model

    big = 2**53 + 1
    few = uploads_of(spark, [(1, 0, 3, ""), (1, 2, 0, ""), (None, 4, None, ""), (2, 6, 1, "")])
    photos = few.withColumn("photo_id", F.col("photo_id") + big)
    listed = models.list_faces(photos.select("search_id", "photo_id", "image"), ["search_id", "photo_id"], factory)
    assert [(r.search_id, r.photo_id, len(r.faces)) for r in listed.orderBy("photo_id").collect()] == [
        (1, big, 3), (1, big + 2, 0), (None, big + 4, 0), (2, big + 6, 1)]
    got = models.assess_faces(listed.selectExpr("photo_id", "inline(faces)"), PROFILE)
    want = models.infer_faces(photos, ["photo_id"], factory, PROFILE)
    assert got.dtypes == want.dtypes
    rows = [sorted(map(str, df.collect())) for df in (got, want)]
    assert rows[0] == rows[1] and len(rows[0]) == 3


def test_no_pixels_in_an_exchange(spark, tmp_path):
    photos = uploads_of(spark, [(1, 1, 1, "image/png")])
    path = str(tmp_path / "photos")
    photos.write.parquet(path)
    faces = models.infer_faces(spark.read.parquet(path), ["photo_id"], a_model("/dev/null"), PROFILE)
    assert "Exchange" not in faces._jdf.queryExecution().executedPlan().toString()
