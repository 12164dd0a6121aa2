from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightmatch.functions import text
from sightmatch.operators import detect, matching, models, quality, tracking, vectors
from sightmatch.params import ENROLMENT, SEARCH, DetectorParams, QualityProfile, TrackerParams

BOX = "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"


def image_table(spark, *pictures):
    rows = [
        (i, (int(p.shape[0]), int(p.shape[1]), int(p.shape[2]), bytearray(p.astype(np.uint8).tobytes())))
        for i, p in enumerate(pictures)
    ]
    return spark.createDataFrame(
        rows, "picture BIGINT, image STRUCT<height: INT, width: INT, nChannels: INT, data: BINARY>"
    )


def checker(n=200):
    return np.repeat(((np.indices((n, n)).sum(axis=0) % 2) * 255)[:, :, None], 3, axis=2)


def test_unit_vectors_and_invalid_ones(spark):
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, []), (5, [float("inf"), 1.0]), (6, None), (7, [None, 1.0])]
    df = spark.createDataFrame(rows, "id INT, embedding ARRAY<FLOAT>")
    valid, invalid = vectors.split_valid_vectors(df)
    unit = vectors.normalize_vectors(valid).collect()
    assert [r.id for r in unit] == [1]
    assert unit[0].embedding == pytest.approx([0.6, 0.8])
    assert sorted(r.id for r in invalid.collect()) == [2, 3, 4, 5, 6, 7]


def _assess(spark, picture, box, score, marks, profile):
    faces = spark.createDataFrame(
        [(0, *map(float, box), score, marks)],
        f"picture BIGINT, {BOX}, detection_score DOUBLE, landmarks ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>",
    )
    measured = quality.add_pose(
        quality.crop_metrics(faces, image_table(spark, picture), ["picture"])
    )
    return quality.score_quality(quality.gate_quality(measured, profile), profile).first()


def test_clear_face_is_accepted(spark):
    wide = QualityProfile(100, 1.0, 0.6, 0.0, 255.0, 25.0, 0.45)
    marks = [(60.0, 80.0), (140.0, 80.0), (100.0, 110.0), (70.0, 140.0), (130.0, 140.0)]
    row = _assess(spark, checker(), (20, 20, 180, 180), 0.99, marks, wide)
    assert row.accepted and row.quality > 0.7


def test_small_dark_blurry_face_gets_every_reason(spark):
    row = _assess(spark, np.zeros((100, 100, 3)), (10, 10, 50, 50), 0.4, None, SEARCH)
    assert row.rejection_reasons == [
        "face_too_small", "detection_score_low", "face_blurry", "face_exposure_bad",
    ]
    assert row.roll_degrees is None and row.yaw_proxy is None


def test_empty_crop_is_invalid_and_nothing_else_about_pixels(spark):
    row = _assess(spark, checker(), (300, 300, 400, 400), 0.9, None, SEARCH)
    assert row.rejection_reasons == ["face_too_small", "invalid_face_crop"]


def test_search_accepts_a_pose_that_enrolment_rejects(spark):
    side = [(60.0, 80.0), (140.0, 80.0), (130.0, 110.0), (70.0, 140.0), (130.0, 140.0)]
    low = {"min_blur": 1.0, "min_brightness": 0.0, "max_brightness": 255.0}
    enrol = QualityProfile(100, min_detection=0.6, max_roll=25.0, max_yaw=0.45, **low)
    search = QualityProfile(80, min_detection=0.45, **low)
    rejected = _assess(spark, checker(), (20, 20, 180, 180), 0.5, side, enrol)
    assert rejected.rejection_reasons == ["detection_score_low", "face_yaw_too_large"]
    assert rejected.yaw_proxy == pytest.approx(0.75)
    assert _assess(spark, checker(), (20, 20, 180, 180), 0.5, side, search).accepted


def test_laplacian_against_a_loop(spark):
    rng = np.random.default_rng(3)
    picture = rng.integers(0, 256, (9, 11, 3))
    row = _assess(spark, picture, (2.9, -1, 8.2, 20), 0.9, None, SEARCH)
    gray = np.rint(picture.astype(float) @ [0.114, 0.587, 0.299])[0:9, 2:8]
    h, w = gray.shape

    def mirrored(i, n):
        return -i if i < 0 else 2 * n - 2 - i if i >= n else i

    values = [
        gray[mirrored(y - 1, h), x] + gray[mirrored(y + 1, h), x] + gray[y, mirrored(x - 1, w)]
        + gray[y, mirrored(x + 1, w)] - 4 * gray[y, x]
        for y in range(h) for x in range(w)
    ]
    assert (row.face_width, row.face_height) == (6, 9)
    assert row.blur_variance == pytest.approx(np.var(values))
    assert row.brightness == pytest.approx(gray.mean())


def test_letterbox_and_anchors(spark):
    frame = spark.createDataFrame([(200, 100)], "width INT, height INT")
    row = detect.add_letterbox(frame).first()
    assert (row.ratio, row.scaled_w, row.scaled_h) == (pytest.approx(2.08), 416, 208)
    grid = detect.anchor_grid(spark)
    assert grid.count() == 3549
    assert grid.groupBy("stride").count().orderBy("stride").collect() == [(8, 2704), (16, 676), (32, 169)]


def test_first_zero_prediction_decodes_to_the_first_cell(spark):
    preds = spark.range(3549).selectExpr(
        "0L AS frame_id", "id AS anchor_idx", "0D AS cx", "0D AS cy", "0D AS w", "0D AS h", "1D AS obj", "1D AS cls0"
    )
    frames = spark.createDataFrame([(0, 416, 416)], "frame_id BIGINT, width INT, height INT")
    boxes = detect.decode_predictions(preds, frames, ["frame_id"])
    first = boxes.where("anchor_idx = 0").first()
    assert (first.x1, first.y1, first.x2, first.y2) == (-4.0, -4.0, 4.0, 4.0)
    assert detect.prediction_count_errors(preds, ["frame_id"]).isEmpty()
    short = detect.prediction_count_errors(preds.where("anchor_idx > 0"), ["frame_id"])
    assert short.first().n_predictions == 3548


def test_nms_keeps_the_best_and_the_distant(spark):
    rows = [(1, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1, 1.0, 1.0, 10.0, 10.0, 0.8), (1, 2, 20.0, 20.0, 30.0, 30.0, 0.7)]
    df = spark.createDataFrame(rows, f"frame_id BIGINT, det_idx BIGINT, {BOX}, score DOUBLE")
    assert sorted(r.det_idx for r in detect.nms(df, ["frame_id"], max_iou=0.5).collect()) == [0, 2]


def test_grid_of_other_input_sizes(spark):
    params = DetectorParams(input_h=64, input_w=96)
    rows = detect.anchor_grid(spark, params).orderBy("anchor_idx").collect()
    want = [
        (x, y, s) for s in (8, 16, 32) for y in range(64 // s) for x in range(96 // s)
    ]
    assert [(r.grid_x, r.grid_y, r.stride) for r in rows] == want


# --- matching ----------------------------------------------------------------------------


def test_both_ways_of_matching_agree_and_ties_go_to_the_first(spark):
    rng = np.random.default_rng(5)
    targets = [(s, 10 * s + i, i, rng.normal(size=8).tolist()) for s in (1, 2) for i in range(300)]
    targets += [(3, 31, 1, [1.0, 0.0]), (3, 30, 0, [0.5, 0.5]), (3, 32, 2, [1.0, 0.0])]
    faces = [(1 + f % 2, 1, f, 0, rng.normal(size=8).tolist()) for f in range(200)]
    faces += [(3, 1, 900, 0, [1.0, 0.0]), (4, 1, 901, 0, [1.0, 0.0])]
    t = spark.createDataFrame(targets, "search_id INT, target_id BIGINT, target_ord INT, embedding ARRAY<FLOAT>")
    f = spark.createDataFrame(faces, "search_id INT, source_id BIGINT, frame_id BIGINT, face_idx BIGINT, embedding ARRAY<FLOAT>")
    one, other = (
        {r.frame_id: (r.target_id, r.target_ord, round(r.similarity, 9)) for r in matching.best_target(f, t, broadcast=b).collect()}
        for b in (True, False)
    )
    assert one == other and len(one) == 201
    assert one[900] == (31, 1, 1.0)


def test_found_target_takes_its_faces_with_it(spark):
    t = spark.createDataFrame(
        [(1, 1, 0, [1.0, 0.0], False), (1, 2, 1, [0.9, 0.43], True)],
        "search_id INT, target_id BIGINT, target_ord INT, embedding ARRAY<FLOAT>, active BOOLEAN",
    )
    f = spark.createDataFrame(
        [(1, 1, 1, 0, [1.0, 0.0]), (1, 1, 2, 0, [0.8, 0.6])],
        "search_id INT, source_id BIGINT, frame_id BIGINT, face_idx BIGINT, embedding ARRAY<FLOAT>",
    )
    assert [r.frame_id for r in matching.match_gallery(f, t, 0.5).collect()] == [2]


def test_thresholds(spark):
    base = spark.range(3)
    assert matching.sweep(base, [0.5, 0.6]).count() == 6
    for bad in ([], [0.5, 0.5], [1.1], [float("nan")]):
        with pytest.raises(ValueError):
            matching.sweep(base, bad)


# --- tracking ----------------------------------------------------------------------------

DET = f"source_id BIGINT, frame_id BIGINT, det_idx BIGINT, {BOX}, score DOUBLE"


def run_tracker(spark, detections, n_frames, params=TrackerParams()):
    sources = sorted({d[0] for d in detections})
    ticks = [(s, f, f * 66) for s in sources for f in range(n_frames)]
    got = tracking.track(
        spark.createDataFrame(ticks, "source_id BIGINT, frame_id BIGINT, captured_ms BIGINT"),
        spark.createDataFrame(detections, DET).repartition(5),
        params,
    )
    return sorted(
        (r.source_id, r.frame_id, r.track_id, r.x1, r.y1, r.x2, r.y2, r.score, r.missed)
        for r in got.collect()
    )


def test_weak_detection_keeps_a_track_and_starts_none(spark):
    strong, weak = (0.0, 0.0, 100.0, 200.0), (2.0, 0.0, 102.0, 200.0)
    got = run_tracker(spark, [(1, 0, 0, *strong, 0.9), (1, 1, 0, *weak, 0.3)], 2)
    assert [(r[1], r[2], r[8]) for r in got] == [(0, 1, 0), (1, 1, 0)]
    assert run_tracker(spark, [(1, 0, 0, *strong, 0.3)], 1) == []


def overlap(a, b):
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    areas = [max(0.0, x[2] - x[0]) * max(0.0, x[3] - x[1]) for x in (a, b)]
    return np.float32(w * h / max(sum(areas) - w * h, 1e-6))


def slow_tracker(detections, n_frames, p):
    """One source, plain lists, every frame."""
    live, next_id, out = [], 1, []
    for frame in range(n_frames):
        found = sorted((d for d in detections if d[1] == frame), key=lambda d: d[2])
        for t in live:
            t["box"] = [b + s for b, s in zip(t["box"], t["speed"], strict=True)]
            t["missed"] += 1
        free, born = list(range(len(live))), []
        for strong, limit in ((True, p.first_iou), (False, p.second_iou)):
            seen = [d for d in found if (d[7] >= p.high if strong else p.low <= d[7] < p.high)]
            pairs = sorted(
                (-overlap(live[t]["box"], d[3:7]), t, i)
                for t in free for i, d in enumerate(seen) if overlap(live[t]["box"], d[3:7]) >= limit
            )
            used = set()
            for _, t, i in pairs:
                if t in free and i not in used:
                    free.remove(t)
                    used.add(i)
                    new = list(seen[i][3:7])
                    speed = [n - b for n, b in zip(new, live[t]["box"], strict=True)]
                    live[t].update(box=new, speed=speed, score=seen[i][7], missed=0)
            if strong:
                born = [d for i, d in enumerate(seen) if i not in used]
        for d in born:
            live.append({"id": next_id, "box": list(d[3:7]), "speed": [0.0] * 4, "score": d[7], "missed": 0})
            next_id += 1
        live = [t for t in live if t["missed"] <= p.buffer]
        out += [(d_source(detections), frame, t["id"], *t["box"], t["score"], t["missed"]) for t in live]
    return out


def d_source(detections):
    return detections[0][0]


def test_tracker_against_a_slow_one_with_idle_stretches(spark):
    rng = random.Random(11)
    params = TrackerParams(buffer=4)
    everything, want = [], []
    for source in (1, 2):
        mine = []
        for frame in range(150):
            # Idle for 5, 6 and many ticks: on both sides of what empties the tracker.
            if 40 <= frame < 45 or 70 <= frame < 76 or 100 <= frame < 130:
                continue
            for d in range(rng.randrange(4)):
                x, y = rng.randrange(0, 60) + frame, rng.randrange(0, 30)
                mine.append((source, frame, d, x, y, x + 50.0, y + 80.0, rng.choice((0.05, 0.2, 0.4, 0.5, 0.8))))
        mine = [tuple(float(v) if i > 2 else v for i, v in enumerate(m)) for m in mine]
        everything += mine
        want += slow_tracker(mine, 150, params)
    got = run_tracker(spark, everything, 150, params)
    assert [g[:3] + (g[8],) for g in got] == [w[:3] + (w[8],) for w in sorted(want)]
    np.testing.assert_allclose([g[3:8] for g in got], [w[3:8] for w in sorted(want)], atol=1e-9)


def test_sources_that_fit_a_task_are_tracked_after_one_shuffle(spark, monkeypatch):
    rng = random.Random(3)
    rows = [
        (s, f, d, *(x := [float(rng.randrange(0, 60)) for _ in range(2)]), x[0] + 50.0, x[1] + 80.0, rng.random())
        for s in (1, 2) for f in range(90) if not 30 <= f < 70 for d in range(2)
    ]
    # A box on a frame that is no tick, and one of no source: neither counts.
    rows += [(2, 500, 0, 0.0, 0.0, 9.0, 9.0, 0.9), (None, 3, 0, 0.0, 0.0, 9.0, 9.0, 0.9)]
    ticks = spark.range(180).selectExpr("id % 2 + 1 AS source_id", "id div 2 AS frame_id", "id AS captured_ms")
    tracks = tracking.track(ticks, spark.createDataFrame(rows, DET), TrackerParams(buffer=4))
    plan = tracks._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    whole = sorted(tracks.collect())
    assert {r.source_id for r in whole} == {1, 2} and max(r.frame_id for r in whole) < 90
    monkeypatch.setattr(tracking.ordered, "fits_a_task", lambda *_: False)
    cut = tracking.track(ticks, spark.createDataFrame(rows, DET), TrackerParams(buffer=4))
    assert cut.columns == tracks.columns and sorted(cut.collect()) == whole


def test_pairs_are_those_in_single_precision_and_no_number_is_none():
    limit = float(np.float32(0.3))
    boxes = [(0.0, 0.0, 10.0, 10.0), (float("nan"), 0.0, 10.0, 10.0)]
    for x in (0.0, 5.0, 5.3846153, 5.3846154, 5.3846155, 9.0, 11.0):
        seen = (x, 0.0, x + 10.0, 10.0, 0.9)
        pairs = tracking.pair_up(boxes, [seen], limit)
        assert pairs == ({0: 0} if overlap(boxes[0], seen[:4]) >= np.float32(limit) else {})
        # The way of many boxes.
        assert tracking.pair_up(boxes[:1] * 301, [seen], limit) == pairs


# --- model slots and texts ---------------------------------------------------------------


def test_model_slots(spark):
    def factory():
        def model(pixels):
            h, w, _ = pixels.shape
            face = {"face_idx": 0, "x1": 0.0, "y1": 0.0, "x2": float(w), "y2": float(h), "detection_score": 0.9,
                    "landmarks": None}
            return [face | {"embedding": [3.0, 4.0]}, face | {"face_idx": 1, "embedding": [0.0, 0.0]}]

        return model

    faces = models.infer_faces(image_table(spark, checker(), np.zeros((5, 5, 3))), ["picture"], factory, ENROLMENT)
    rows = {r.picture: r for r in faces.collect()}
    assert len(rows) == 2
    assert rows[0].embedding == pytest.approx([0.6, 0.8])
    assert not rows[1].accepted and "face_too_small" in rows[1].rejection_reasons


@pytest.mark.parametrize(
    ("uri", "masked"),
    [
        ("rtsp://user:pw@Cam.local:8554/a?b=c", "rtsp://cam.local:8554/***"),
        ("RTSPS://cam/x", "rtsps://cam/***"),
        ("rtsp://", "rtsp://source/***"),
        ("rtsp://u:p@w@10.0.0.1/x", "rtsp://10.0.0.1/***"),
    ],
)
def test_addresses_lose_their_secrets(spark, uri, masked):
    row = spark.createDataFrame([(uri,)], "uri STRING").select(text.mask_uri(F.col("uri"))).first()
    assert row[0] == masked


def test_both_ways_of_matching_agree(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK_BYTES", 3 * 8 * 4)
    monkeypatch.setattr(matching, "FACES_PER_TASK", 7)
    rng = random.Random(6)
    vector = lambda n=4: [rng.choice((-1.0, 0.0, 0.5, 1.0)) for _ in range(n)]
    targets = [(s, s * 100 + i, i // 2, vector()) for s in (1, 2) for i in range(11)]
    targets += [(2, 300, None, vector()), (1, 301, 50, None), (1, 302, 51, [1.0, None, 0.0, 0.0]), (3, 303, 1, vector(2))]
    faces = [(rng.choice((1, 2, 3, 4)), 1, f, i, vector(), "x") for f in range(20) for i in range(2)]
    faces += [(1, 1, 90, 0, [1.0, 1.0], "x"), (1, 1, 91, 0, None, "x"), (3, 1, 92, 0, [1.0, 0.5], "x")]
    faces += [(1, 1, 93, 0, [], "x"), (None, 1, 94, 0, vector(), "x"), (2, 1, 95, 0, [1.0, None, 1.0, 1.0], "x")]
    f = spark.createDataFrame(
        faces, "search_id LONG, source_id LONG, frame_id LONG, face_idx LONG, embedding ARRAY<FLOAT>, note STRING"
    ).repartition(3)
    t = spark.createDataFrame(targets[:22] + targets[23:], "search_id LONG, target_id LONG, target_ord INT, embedding ARRAY<FLOAT>")
    best = {}
    for search, source, frame, idx, own, _ in faces:
        scored = [
            (sum(a * b for a, b in zip(own, v, strict=True)), -o, -i)
            for s, i, o, v in targets[:22] + targets[23:]
            if s == search and own and v and len(v) == len(own) and None not in own and None not in v
        ]
        if scored:
            best[(search, source, frame, idx)] = (max(scored)[0], -max(scored)[1])
    for way in (True, False):
        got = matching.best_target(f, t, broadcast=way).collect()
        assert {(r.search_id, r.source_id, r.frame_id, r.face_idx): (r.similarity, r.target_ord) for r in got} == best
        assert len(got) == len(best)
