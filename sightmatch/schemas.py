"""Schemas of the tables that sources declare instead of inferring."""

from __future__ import annotations

FRAMES = "source_id BIGINT, frame_id BIGINT, captured_ms BIGINT, captured_at TIMESTAMP, width INT, height INT"

DETECTIONS = (
    "source_id BIGINT, frame_id BIGINT, captured_ms BIGINT, det_idx BIGINT,"
    " x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, score DOUBLE"
)

# What an evidence stream carries: a row per scored face, and a row without target (nor search)
# per frame.
SIGHTINGS = (
    "search_id BIGINT, source_id BIGINT, frame_id BIGINT, captured_ms BIGINT, captured_at TIMESTAMP,"
    " target_id BIGINT, track_id BIGINT, similarity DOUBLE, quality DOUBLE"
)

EVENTS = (
    "search_id BIGINT, source_id BIGINT, target_id BIGINT, track_id BIGINT, frame_id BIGINT, captured_ms BIGINT,"
    " state STRING, similarity DOUBLE, quality DOUBLE, evidence_count BIGINT"
)

TRACKS = (
    "source_id BIGINT, frame_id BIGINT, captured_ms BIGINT, track_id BIGINT,"
    " x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, score DOUBLE, missed INT"
)

MANIFEST = (
    "version INT, cases ARRAY<STRUCT<id: STRING, photo: STRING, video: STRING,"
    " target_name: STRING, expected_intervals_seconds: ARRAY<ARRAY<DOUBLE>>>>"
)
