"""Streams over several micro-batches give the rows of the batch operators."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from sightmatch import schemas
from sightmatch.operators import association, eventlog, evidence, searches, tracking
from sightmatch.params import EvidenceParams
from sightmatch.plans import live, pipelines
from sightmatch.sources import readers, sinks
from sightmatch.streaming import queries as streams


def drain(stream, tmp_path, name):
    query = sinks.write_event_log(stream, str(tmp_path / name), str(tmp_path / f"{name}-ck"))
    query.awaitTermination()
    return stream.sparkSession.read.parquet(str(tmp_path / name))


def in_files(df, path, key, n=8):
    """Rows dealt over n files at random, then a file whose row lets the watermark pass them."""
    df.repartition(n).write.parquet(path)
    later = {key: -1, "captured_ms": 100_000_000}
    last = df.sparkSession.range(1).select(*[F.lit(later.get(c)).cast(k).alias(c) for c, k in df.dtypes])
    last.coalesce(1).write.mode("append").parquet(path)
    return path


def same(a, b):
    columns = sorted(a.columns)
    a, b = a.select(*columns), b.select(*columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_confirm_stream(spark, tmp_path):
    rng = random.Random(2)
    seen, log = [], []
    for source in (1, 2):
        at = 1_000_000
        for frame in range(90):
            at += rng.choice((66, 200, 250, 2500 if frame % 20 == 0 else 100))
            log.append((source, frame, at))
            seen += [(1, source, t, frame, at, rng.random(), 0.5) for t in (1, 2) if rng.random() < 0.6]
    seen = spark.createDataFrame(
        seen, "target_id BIGINT, source_id BIGINT, track_id BIGINT, frame_id BIGINT, captured_ms BIGINT, similarity DOUBLE, quality DOUBLE"
    )
    log = spark.createDataFrame(log, "source_id BIGINT, frame_id BIGINT, captured_ms BIGINT")
    path = in_files(streams.as_sightings(seen, log), str(tmp_path / "in"), "source_id")
    params = EvidenceParams(required=2)
    stream = readers.stream_frames(spark, path, schemas.SIGHTINGS, 1)
    got = drain(streams.confirm_stream(stream, 0.3, params, "1 hour"), tmp_path, "events").drop("search_id")
    want = evidence.confirm(seen, log, params, 0.3)
    assert {"lost", "confirmed"} <= {r.state for r in want.select("state").distinct().collect()}
    assert same(got, want)


def test_track_stream(spark, tmp_path):
    rng = random.Random(4)
    rows = [
        (s, f, f * 66, d, float(f + d * 20), 0.0, float(f + d * 20 + 40), 90.0, rng.choice((0.2, 0.6, 0.9)))
        for s in (1, 2) for f in range(60) for d in range(3) if rng.random() < 0.8 or d == 0
    ]
    found = spark.createDataFrame(rows, schemas.DETECTIONS)
    path = in_files(found, str(tmp_path / "in"), "source_id")
    stream = readers.stream_frames(spark, path, schemas.DETECTIONS, 1)
    got = drain(streams.track_stream(stream, lateness="1 hour", origin_ms=1), tmp_path, "tracks")
    ticks = found.select("source_id", "frame_id", "captured_ms").distinct()
    assert same(got, tracking.track(ticks, found))


def test_outages_and_silence(spark, tmp_path):
    start = 1_704_067_200_000
    rows = [(1, f, start + f * 100 + (5000 if f > 10 else 0)) for f in range(30)]
    rows += [(2, f, start + f * 100) for f in range(5)] + [(3, f, start + f * 500) for f in range(40)]
    log = spark.createDataFrame(rows, "source_id BIGINT, frame_id BIGINT, captured_ms BIGINT").selectExpr(
        "*", "timestamp_millis(captured_ms) AS captured_at", "1 AS width", "1 AS height"
    )
    path = str(tmp_path / "in")
    log.coalesce(1).write.parquet(path)
    got = drain(streams.outage_stream(readers.stream_frames(spark, path), 1000), tmp_path, "outages")
    told = sorted((r.source_id, r.at_ms - start, r.status) for r in got.collect())
    batch = sorted((r.source_id, r.at_ms - start, r.status) for r in searches.source_transitions(log, 1000).collect())
    # Two sources have fallen silent by the end of the stream; only time can tell.
    assert [t for t in told if t not in batch] == [(1, 8900, "source_lost"), (2, 1400, "source_lost")]
    assert [t for t in batch if t not in told] == []


def test_late_rows_are_counted(spark, tmp_path):
    path = str(tmp_path / "in")
    kinds = "source_id BIGINT, captured_ms BIGINT"
    for at in (100_000, 200_000, 300_000, 110_000, 400_000):
        spark.createDataFrame([(1, at)], kinds).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.1)
    stream = streams.outage_stream(readers.stream_frames(spark, path, kinds, 1), 1000, "10 seconds")
    query = sinks.write_event_log(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    assert streams.late_rows(query) == 1
    starts = {r.at_ms for r in spark.read.parquet(str(tmp_path / "out")).where("status = 'running'").collect()}
    assert starts == {100_000, 200_000, 300_000}


def test_live_chain(spark, tmp_path):
    """Frames to sightings to events, against the batch pipeline on the same rows. Two searches
    share a source and a target id."""
    rng = random.Random(9)
    targets = spark.createDataFrame(
        [(1, 10, 0, [1.0, 0.0]), (1, 11, 1, [0.0, 1.0]), (2, 10, 0, [0.0, 1.0])],
        "search_id BIGINT, target_id BIGINT, target_ord INT, embedding ARRAY<FLOAT>",
    )
    rows = []
    for frame in range(50):
        at = 1_000_000 + frame * 210 + (6000 if frame > 25 else 0)
        for search in (1, 2):
            faces = [
                (i, 20.0 + 200 * i, 20.0, 40.0 + 200 * i, 40.0, rng.random(), rng.random() < 0.9,
                 [0.9, 0.1] if rng.random() < 0.5 + i / 3 else [0.2, 0.95])
                for i in range(2) if rng.random() < 0.5
            ]
            tracks = [(1, 0.0, 0.0, 100.0, 200.0), (2, 200.0, 0.0, 300.0, 200.0)] if search == 1 else []
            rows.append((search, 5, frame, at, faces, tracks))
    table = spark.createDataFrame(rows, live.SEEN_FRAMES)
    path = in_files(table, str(tmp_path / "in"), "source_id", 4)
    stream = readers.stream_frames(spark, path, live.SEEN_FRAMES, 1)
    seen, out = str(tmp_path / "seen"), str(tmp_path / "events")
    # Faces and tracks of a frame must meet in one batch; here each frame is one row per search.
    frames = stream.where("source_id IS NOT NULL")
    live.store_sightings(frames, targets, 0.5, seen, str(tmp_path / "ck1")).awaitTermination()
    live.store_events(spark, seen, 0.5, out, str(tmp_path / "ck2"), lateness="1 hour").awaitTermination()
    got = spark.read.parquet(out)

    keys = ["search_id", "source_id", "frame_id", "captured_ms"]
    stored = spark.read.schema(schemas.SIGHTINGS).parquet(f"{seen}/batch=*").where("source_id = 5")
    found = stored.where("target_id IS NOT NULL")
    assert {r.search_id for r in found.select("search_id").distinct().collect()} >= {1}
    ticks = table.select(*keys).drop("search_id").distinct()
    want = searches.retire_found(evidence.confirm(found, ticks, threshold=0.5))
    told = {(r.state, r.search_id) for r in got.collect()}
    assert ("candidate", 1) in told and ("confirmed", 1) in told and "lost" not in {s for s, _ in told}
    assert same(got.select(*want.columns), want)


def test_state_of_an_ended_search_leaves(spark, tmp_path):
    """Once searches have been silent for idle_ms, no state of theirs is left."""
    rows = [
        (search, 7, frame, 1_000_000 + frame * 250, target, 3, 0.9, 0.5)
        for search in (1, 2)
        for frame in range(12)
        for target in ((None,) if frame % 2 else (None, 10, 11))
    ]
    table = spark.createDataFrame(
        rows,
        "search_id BIGINT, source_id BIGINT, frame_id BIGINT, captured_ms BIGINT, target_id BIGINT,"
        " track_id BIGINT, similarity DOUBLE, quality DOUBLE",
    ).selectExpr("*", "timestamp_millis(captured_ms) AS captured_at").select(
        *streams._names(schemas.SIGHTINGS)
    )
    path = str(tmp_path / "in")
    table.coalesce(1).write.parquet(path)
    for at in (1_400_000, 1_500_000, 1_600_000):
        time.sleep(0.1)
        row = spark.range(1).select(
            *[F.lit({"search_id": 9, "source_id": 8, "captured_ms": at}.get(c)).cast(k).alias(c) for c, k in table.dtypes]
        )
        row.coalesce(1).write.mode("append").parquet(path)
    for retire in (False, True):
        stream = readers.stream_frames(spark, path, schemas.SIGHTINGS, 1)
        events = streams.confirm_stream(stream, 0.5, lateness="1 second", retire=retire, idle_ms=60_000)
        query = sinks.write_event_log(events, str(tmp_path / f"out{retire}"), str(tmp_path / f"ck{retire}"))
        query.awaitTermination()
        told = spark.read.parquet(str(tmp_path / f"out{retire}"))
        assert told.where("state = 'confirmed'").count() == 4
        state = spark.read.format("statestore").option("stateVarName", "evidence").load(str(tmp_path / f"ck{retire}"))
        assert state.count() == 0
        for name in ("found", "last", "waiting"):
            left = spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / f"ck{retire}"))
            assert {r.key["_search_id"] for r in left.select("key").collect()} <= {"9"}


def test_numbers_go_on_after_a_restart(spark, tmp_path):
    """Three batches, the last two after a restart from the checkpoint: every number once, as in the batch
    form, and each envelope its own id."""
    rng = random.Random(5)
    kinds = "search_id BIGINT, occurred_at BIGINT, frame_id BIGINT, type STRING, target_id BIGINT"
    events = [
        (s, 1_000_000 + 100 * (i // 2), i, rng.choice(("candidate", "lost")), rng.choice((1, 2, None)))
        for s in (1, 2, 3) for i in range(60)
    ]
    path, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    parts = [[e for e in events if lo <= e[2] < lo + 20] for lo in (0, 20, 40)]

    def run(*batches):
        for rows in batches:
            spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(path)
            time.sleep(0.1)
        stream = readers.stream_frames(spark, path, kinds, 1)
        log = streams.event_log_stream(stream, ["frame_id"], ["target_id"], "1 second")
        sinks.write_event_log(log, out, checkpoint, {"availableNow": True}).awaitTermination()
        return spark.read.parquet(out)

    first = run(rng.sample(parts[0], len(parts[0])))
    n = first.count()
    assert n < len(events)
    log = run(*[rng.sample(p, len(p)) for p in parts[1:]], [(9, 90_000_000, 0, "candidate", None)])
    want = eventlog.to_event_log(spark.createDataFrame(events, kinds), ["frame_id"], ["target_id"])
    assert same(log.drop("event_id"), want.drop("event_id"))
    assert log.select("event_id").distinct().count() == len(events)
    after = eventlog.replay(log, 50)
    assert [(r.search_id, r.seq) for r in after.collect()] == [(s, n) for s in (1, 2, 3) for n in range(51, 61)]
    assert spark.read.format("statestore").option("stateVarName", "waiting").load(checkpoint).count() == 1
    with pytest.raises(ValueError, match="vectors"):
        streams.event_log_stream(log, [], ["embedding"])


def test_cadence_and_runs_as_streams(spark, tmp_path):
    rng = random.Random(6)
    frames, ticks, tracks = [], [], []
    for source in (1, 2, 3):
        at = 1_000_000
        for frame in range(80):
            at += rng.choice((0, 40, 120, 4000 if frame == 30 else 70))
            frames.append((source, frame, at))
            if frame % 4 == 2 and source != 3:
                ticks.append((source, frame, at))
                # Some runs find nothing.
                tracks += [
                    (source, frame, at, t, 1.0 * t, 0.0, 9.0, 9.0, rng.random()) for t in range(rng.choice((0, 1, 3)))
                ]
    kinds = "source_id BIGINT, frame_id BIGINT, captured_ms BIGINT"
    frames, ticks = (spark.createDataFrame(rows, kinds) for rows in (frames, ticks))
    tracks = spark.createDataFrame(
        tracks, f"{kinds}, track_id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, score DOUBLE"
    )
    paths = {
        name: in_files(rows, str(tmp_path / name), "source_id", 2)
        for name, rows in (("frames", frames), ("ticks", ticks), ("tracks", tracks))
    }
    read = lambda name, rows: readers.stream_frames(spark, paths[name], rows.schema, 1)
    got = drain(streams.run_every_stream(read("frames", frames), 5.0, "1 hour"), tmp_path, "runs")
    assert same(got, evidence.run_every(frames, 5.0))
    for given in (ticks, None):
        more = () if given is None else (read("ticks", ticks),)
        stream = streams.tracks_as_of_stream(read("frames", frames), read("tracks", tracks), *more, lateness="1 hour")
        got = drain(stream, tmp_path, f"as-of-{len(more)}")
        want = association.tracks_as_of(frames, tracks, given)
        assert got.count() > 100
        assert same(got, want.select(*got.columns))


def test_rows_of_a_batch_wait_as_one_entry_until_some_are_due(spark, tmp_path):
    """A call to the state store per slice and key made large inputs too slow. What is not due yet then
    waits by slices, and all comes out in order."""
    kinds = "source_id BIGINT, captured_ms BIGINT"
    path, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    times = [1_000_000 + 700 * i + (9_000 if i > 20 else 0) for i in range(40)]

    def run(rows):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(path)
        stream = readers.stream_frames(spark, path, kinds, 1)
        query = sinks.write_event_log(streams.outage_stream(stream, 2_000, "1 second"), out, checkpoint)
        query.awaitTermination()
        return spark.read.format("statestore").option("stateVarName", "waiting").load(checkpoint)

    # The watermark is still before the first row when the batch's own rows are taken in.
    first = spark.createDataFrame([(1, t) for t in times], kinds)
    first.coalesce(1).write.parquet(str(tmp_path / "held"))
    held = readers.stream_frames(spark, str(tmp_path / "held"), kinds, 1)
    query = sinks.write_event_log(
        streams.outage_stream(held, 2_000, "1 hour"), str(tmp_path / "none"), str(tmp_path / "held-ck")
    )
    query.awaitTermination()
    state = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "held-ck"))
    assert state.count() == 1
    half = random.Random(2).sample(times[:30], 30)
    run([(1, t) for t in half])
    run([(1, t) for t in times[30:]])
    run([(9, 90_000_000)])
    told = [(r.at_ms, r.status) for r in spark.read.parquet(out).where("source_id = 1").collect()]
    assert sorted(told) == [
        (times[0], "running"), (times[20] + 2_000, "source_lost"), (times[21], "running"),
        (times[-1] + 2_000, "source_lost"),
    ]


def test_keys_of_a_bucket_share_one_state(spark, tmp_path):
    """A call of the processor and several to the state store per source made inputs of many sources too
    slow. In buckets there is one entry per bucket and micro-batch, and the rows stay the same."""
    rng = random.Random(8)
    big = 2**60 + 1
    log = [
        (big + s, f, f * 300 + (5_000 if f > 12 and s % 3 == 0 else 0) + 40 * s) for s in range(40) for f in range(25)
    ]
    frames = spark.createDataFrame(log, "source_id BIGINT, frame_id BIGINT, captured_ms BIGINT")
    found = spark.createDataFrame(
        [
            (s, f, at, d, *((float(f + d * 20), 0.0, float(f + d * 20 + 40), 90.0, rng.choice((0.2, 0.6, 0.9)))
             if d is not None else (None,) * 5))
            for s, f, at in log for d in ((0, 1) if f % 3 else (None,))
        ],
        schemas.DETECTIONS,
    )
    tracks = spark.createDataFrame(
        [(s, f, at, big + f, 1.0 * s, 0.0, 9.0, 9.0, 0.5) for s, f, at in log if f % 4 == 1],
        "source_id BIGINT, frame_id BIGINT, captured_ms BIGINT, track_id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE,"
        " y2 DOUBLE, score DOUBLE",
    )
    paths = {
        name: in_files(rows, str(tmp_path / name), "source_id", 2)
        for name, rows in (("log", frames), ("found", found), ("tracks", tracks))
    }
    read = lambda name, rows: readers.stream_frames(spark, paths[name], rows.schema, 1)
    how = {"lateness": "1 hour", "origin_ms": 1_000_000}
    makers = {
        "track": lambda **more: streams.track_stream(read("found", found), **how, **more),
        "outage": lambda **more: streams.outage_stream(read("log", frames), 1_000, idle_ms=3_000, **how, **more),
        "as_of": lambda **more: streams.tracks_as_of_stream(
            read("log", frames), read("tracks", tracks), **how, **more
        ),
    }
    for name, make in makers.items():
        alone, together = (drain(make(buckets=n), tmp_path, f"{name}-{n}") for n in (None, 3))
        assert alone.count() > 40
        assert together.schema == alone.schema
        if name == "outage":
            assert same(alone, together)
    track = spark.read.parquet(str(tmp_path / "track-3"))
    ticks = found.select("source_id", "frame_id", "captured_ms").distinct()
    assert same(track, tracking.track(ticks, found.where("score IS NOT NULL")))
    placed = spark.read.parquet(str(tmp_path / "as_of-3"))
    want = association.tracks_as_of(frames, tracks)
    assert same(placed, want.select(*placed.columns))

    held = readers.stream_frames(spark, f"{tmp_path}/log", frames.schema, 1).where("source_id >= 0")
    query = sinks.write_event_log(
        streams.outage_stream(held, 1_000, "1 hour", 1_000_000, buckets=3), str(tmp_path / "none"), str(tmp_path / "ck")
    )
    query.awaitTermination()
    state = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "ck"))
    assert 0 < state.count() <= 2 * 3


def test_numbers_and_evidence_in_buckets(spark, tmp_path):
    """What keys remember survives micro-batches and a restart, and is forgotten in silence."""
    kinds = "search_id BIGINT, source_id BIGINT, frame_id BIGINT, captured_ms BIGINT, target_id BIGINT," \
        " track_id BIGINT, similarity DOUBLE, quality DOUBLE"
    rng = random.Random(3)
    rows = [
        (search, 7, frame, 1_000_000 + frame * 250, target, 3, rng.random(), 0.5)
        for search in (None, *range(1, 9)) for frame in range(24)
        for target in ((None,) if frame % 3 == 2 else (None, 10, 11))
    ]
    path = str(tmp_path / "in")
    parts = [rows[i::3] for i in range(3)]
    last = [[(99, 8, 0, at, None, None, None, None)] for at in (1_400_000, 1_500_000, 1_600_000)]
    for part in [*parts, *last]:
        spark.createDataFrame(part, kinds).selectExpr("*", "timestamp_millis(captured_ms) AS captured_at").select(
            *streams._names(schemas.SIGHTINGS)
        ).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.1)
    for retire in (False, True):
        told = {}
        for buckets in (None, 2):
            stream = readers.stream_frames(spark, path, schemas.SIGHTINGS, 1)
            events = streams.confirm_stream(
                stream, 0.3, lateness="10 seconds", retire=retire, idle_ms=60_000, buckets=buckets
            )
            name = f"{retire}-{buckets}"
            query = sinks.write_event_log(events, str(tmp_path / name), str(tmp_path / f"{name}-ck"))
            query.awaitTermination()
            told[buckets] = spark.read.parquet(str(tmp_path / name))
        assert told[None].where("state = 'confirmed'").count() > 5
        assert same(told[None], told[2])
        left = spark.read.format("statestore").option("stateVarName", "memory").load(str(tmp_path / f"{retire}-2-ck"))
        assert "[\"1\"," not in "".join(r.value["keys"] for r in left.collect())
