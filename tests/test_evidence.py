from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sightmatch.operators import association, evidence, searches
from sightmatch.params import EvidenceParams
from sightmatch.streaming import state as step

SEEN = (
    "target_id BIGINT, source_id BIGINT, track_id BIGINT, frame_id BIGINT, captured_ms BIGINT,"
    " similarity DOUBLE, quality DOUBLE"
)
LOG = "source_id BIGINT, frame_id BIGINT, captured_ms BIGINT"


def events(spark, seen, log, threshold=0.8, params=EvidenceParams(), **more):
    df = evidence.confirm(
        spark.createDataFrame(seen, SEEN), spark.createDataFrame(log, LOG), params, threshold, **more
    )
    return df.orderBy("frame_id", "state").collect()


def hits(*times):
    return [(1, 1, 7, i, t, 1.0, 0.9) for i, t in enumerate(times)]


def ticks(*times):
    return [(1, i, t) for i, t in enumerate(times)]


def test_three_separated_hits_confirm_and_silence_loses(spark):
    got = events(spark, hits(0, 200, 400), ticks(0, 200, 400, 2390, 2400, 2500))
    assert [(r.state, r.captured_ms, r.evidence_count) for r in got] == [
        ("candidate", 0, 1),
        ("confirmed", 400, 3),
        ("lost", 2400, 0),
    ]


def test_not_lost_before_the_grace_is_over(spark):
    got = events(spark, hits(0, 200, 400), ticks(0, 200, 400, 2390))
    assert "lost" not in {r.state for r in got}


def test_hits_too_close_do_not_add_up(spark):
    got = events(spark, hits(0, 100, 199), ticks(0, 100, 199), params=EvidenceParams(required=2))
    assert [r.state for r in got] == ["candidate"]


def test_evidence_runs_out(spark):
    window = EvidenceParams(window_ms=1000)
    got = events(spark, hits(0, 1001, 1201), ticks(0, 1001, 1201), params=window)
    assert [(r.state, r.evidence_count) for r in got] == [("candidate", 1), ("candidate", 1)]


def brute_force(seen, log, threshold, params):
    """Every key on every frame of its source, one after the other."""
    by_source = {}
    for source, frame, at in sorted(log):
        by_source.setdefault(source, []).append((frame, at))
    faces = {(t, s, k, f): (sim, q) for t, s, k, f, _, sim, q in seen}
    out = []
    for target, source, track in sorted({r[:3] for r in seen}):
        memory = step.EMPTY
        for frame, at in by_source[source]:
            told = []
            if (target, source, track, frame) in faces:
                memory, told = step.on_face(
                    memory, at, *faces[target, source, track, frame], threshold, params
                )
            memory, more = step.on_tick(memory, at, params)
            memory = memory or step.EMPTY
            out += [(target, source, track, frame, at, *e) for e in told + more]
    return sorted(out)


@pytest.mark.parametrize(
    ("seed", "size", "params"),
    [
        (1, 600_000, EvidenceParams()),
        (2, 1500, EvidenceParams()),
        (3, 2000, EvidenceParams(required=2, window_ms=2000)),
        (4, 4000, EvidenceParams(required=4, window_ms=900, throttle_ms=50, separation_ms=130)),
    ],
)
def test_random_streams_match_brute_force(spark, seed, size, params):
    rng = random.Random(seed)
    seen, log = [], []
    for source in (1, 2, 3):
        at = 0
        # One source carries most of the rows.
        for frame in range(700 if source == 1 else 60):
            at += rng.choice((0, 30, 66, 100, 200, 250, 2400 if rng.random() < 0.1 else 66))
            log.append((source, frame, at))
            for target in (1, 2):
                for track in (1, 2):
                    if rng.random() < 0.55 and (frame // 40 + track) % 3:
                        seen.append((target, source, track, frame, at, rng.random(), rng.random()))
    rng.shuffle(seen)
    got = events(spark, seen, log, 0.4, params, size=size)
    got = sorted(
        (
            r.target_id, r.source_id, r.track_id, r.frame_id, r.captured_ms, r.state,
            r.similarity, r.quality, r.evidence_count,
        )
        for r in got
    )
    assert got == brute_force(seen, log, 0.4, params)
    assert {r[5] for r in got} == {"candidate", "confirmed", "lost"}


def test_refuses_what_does_not_decompose(spark):
    with pytest.raises(ValueError):
        events(spark, hits(0), ticks(0), params=EvidenceParams(window_ms=3000))
    with pytest.raises(ValueError):
        EvidenceParams(throttle_ms=3000)


def test_one_face_per_frame_and_track(spark):
    faces = spark.createDataFrame(
        [(1, 1, 0, 7, 0.5, True), (1, 1, 1, 7, 0.9, False), (1, 1, 2, 7, 0.6, True), (1, 1, 3, 7, 0.6, True)],
        "source_id BIGINT, frame_id BIGINT, face_idx BIGINT, track_id BIGINT, quality DOUBLE, accepted BOOLEAN",
    )
    assert [r.face_idx for r in association.best_face_per_track(faces).collect()] == [2]


FACE = "source_id BIGINT, frame_id BIGINT, face_idx BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
TRACK = "source_id BIGINT, frame_id BIGINT, track_id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"


def test_smallest_upper_body_box_takes_the_face(spark):
    faces = spark.createDataFrame([(1, 1, 0, 40.0, 20.0, 60.0, 50.0)], FACE)
    tracks = spark.createDataFrame(
        [(1, 1, 1, 0.0, 0.0, 100.0, 200.0), (1, 1, 2, 30.0, 10.0, 70.0, 100.0)], TRACK
    )
    assert [r.track_id for r in association.associate_faces(faces, tracks).collect()] == [2]


def test_face_below_the_upper_body_finds_no_track(spark):
    faces = spark.createDataFrame([(1, 1, 0, 40.0, 150.0, 60.0, 180.0)], FACE)
    tracks = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 100.0, 200.0)], TRACK)
    assert association.associate_faces(faces, tracks).isEmpty()


def test_last_box_of_the_track(spark):
    log = spark.createDataFrame(
        [(1, 7, 5, "lost"), (1, 7, 1, "candidate")],
        "source_id BIGINT, track_id BIGINT, frame_id BIGINT, state STRING",
    )
    tracks = spark.createDataFrame(
        [(1, 1, 7, 0.0, 0.0, 1.0, 1.0), (1, 3, 7, 2.0, 2.0, 3.0, 3.0), (1, 6, 7, 9.0, 9.0, 9.0, 9.0)], TRACK
    )
    got = {r.state: r.bbox.x1 for r in evidence.with_track_box(log, tracks).collect()}
    assert got == {"candidate": 0.0, "lost": 2.0}


def test_retired_target_keeps_the_whole_frame(spark):
    rows = [(1, 1, 4, "candidate"), (1, 1, 5, "confirmed"), (1, 1, 5, "confirmed"), (1, 1, 6, "lost"), (1, 2, 9, "candidate")]
    table = spark.createDataFrame(rows, "search_id BIGINT, target_id BIGINT, captured_ms BIGINT, state STRING")
    kept = searches.retire_found(table)
    assert sorted(r.captured_ms for r in kept.collect()) == [4, 5, 5, 9]
    assert searches.target_found_events(kept).agg(F.count("*")).first()[0] == 2
