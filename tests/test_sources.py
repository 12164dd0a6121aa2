from __future__ import annotations

import hashlib
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from sightmatch.operators import admission, eventlog, evaluation, models, quality
from sightmatch.params import NO_THRESHOLD, THRESHOLD_RANGE, THRESHOLD_REPEATED, check_thresholds
from sightmatch.sources import readers, scratch, sinks


def png(width, height, bgr):
    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    row = b"\0" + bytes(reversed(bgr)) * width
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return (
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(row * height)) + chunk(b"IEND", b"")
    )


def test_photos(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(3, 2, (1, 2, 3)))
    (tmp_path / "b.png").write_bytes(b"not a picture")
    rows = {r.filename: r for r in readers.read_photos(spark, str(tmp_path)).collect()}
    assert (rows["a.png"].width, rows["a.png"].height, rows["a.png"].error_code) == (3, 2, None)
    assert bytes(rows["a.png"].image.data[:3]) == bytes((1, 2, 3))
    assert rows["b.png"].error_code == "image_decode_failed"


def _picture(spark, path, kind, channels):
    """A picture of 5 x 4 pixels by Java's writers; channels: gray (1), color (3) or with transparency (4)."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(5, 4, {1: 10, 3: 5, 4: 6}[channels])
    for k in range(20):
        image.setRGB(k % 5, k // 5, (k * 7919 * 65537) % 2**31)
    assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(str(path)))


def test_photos_are_those_of_the_image_source(spark, tmp_path):
    for part in ("a", "b c"):
        folder = tmp_path / part
        (folder / "below").mkdir(parents=True)
        for kind, channels in (("png", 1), ("png", 3), ("png", 4), ("jpg", 1), ("jpg", 3), ("gif", 3), ("bmp", 3)):
            _picture(spark, folder / f"{kind} {channels}%.{kind}", kind, channels)
        _picture(spark, folder / "below" / "x.png", "png", 1)
        (folder / "cut.png").write_bytes(png(3, 2, (1, 2, 3))[:30])
        (folder / "none.png").write_bytes(b"not a picture")
        (folder / "empty.png").write_bytes(b"")
        (folder / ".hidden.png").write_bytes(png(3, 2, (1, 2, 3)))
        (folder / "_hidden.png").write_bytes(png(3, 2, (1, 2, 3)))
    path = f"{tmp_path}/*"
    image = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    want = {r.origin: r.asDict() for r in image.collect()}
    found = readers.read_photos(spark, path).collect()
    assert len(found) == len(want) == 18
    for row in found:
        known = want[row.path]
        assert row.filename == row.path.rsplit("/", 1)[1]
        if known["height"] < 0:
            assert (row.image, row.width, row.height, row.error_code) == (None, None, None, "image_decode_failed")
        else:
            assert row.image.asDict() == known
            assert (row.width, row.height, row.error_code) == (5, 4, None)


def test_many_small_photos_are_read_by_few_tasks(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"{k}.png").write_bytes(png(3, 2, (1, 2, k % 256)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    try:
        photos = readers.read_photos(spark, str(tmp_path))
        assert photos.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        assert photos.select("path").distinct().count() == 300
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_checksums(spark, tmp_path):
    (tmp_path / "m.bin").write_bytes(b"model")
    good = hashlib.sha256(b"model").hexdigest()
    want = spark.createDataFrame(
        [("m.bin", good.upper()), ("gone.bin", good)], "filename STRING, sha256 STRING"
    )
    got = {r.filename: r.status for r in readers.audit_checksums(spark, str(tmp_path), want).collect()}
    assert got == {"m.bin": "ok", "gone.bin": "missing"}
    wrong = spark.createDataFrame([("m.bin", "00")], "filename STRING, sha256 STRING")
    assert readers.audit_checksums(spark, str(tmp_path), wrong).first().status == "mismatch"


def test_manifest(spark, tmp_path):
    case = {"id": "a", "photo": "m/t.png", "video": "/v.mp4", "target_name": " N ", "expected_intervals_seconds": [[1, 3], [5.5, 8]]}
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps({"version": 1, "cases": [case, case | {"id": "b", "expected_intervals_seconds": []}]}, indent=1))
    cases, intervals = readers.read_manifest(spark, str(path))
    first = cases.orderBy("case_no").first()
    assert (first.photo, first.video, first.target_name) == (f"{tmp_path}/m/t.png", "/v.mp4", "N")
    assert [(r.case_id, r.idx, r.start_ms, r.end_ms) for r in intervals.orderBy("idx").collect()] == [
        ("a", 0, 1000, 3000), ("a", 1, 5500, 8000),
    ]
    assert evaluation.validate_manifest(cases).where("error_code IS NOT NULL").isEmpty()
    assert evaluation.validate_intervals(intervals).isEmpty()


def test_manifest_errors(spark, tmp_path):
    case = {"id": "a", "photo": "t.png", "video": "/v.mp4", "target_name": "N", "expected_intervals_seconds": [[1, 3]]}
    odd = case | {"id": "b", "expected_intervals_seconds": [[1, 3], [4, 5, 6]]}
    bodies = {
        "good.json": json.dumps({"version": 1, "cases": [case]}, indent=1),
        "odd.json": json.dumps({"version": 1, "cases": [case, odd]}),
        "none.json": json.dumps({"version": 1, "cases": []}),
        "other.json": json.dumps({"version": 2, "cases": [case]}),
        "cut.json": json.dumps({"version": 1, "cases": [case]})[:40],
        "empty.json": "",
    }
    for name, body in bodies.items():
        (tmp_path / name).write_text(body)
    got = readers.manifest_errors(spark, str(tmp_path / "*.json")).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.case_id or "", r.error_code) for r in got) == [
        ("cut.json", "", "unreadable_manifest"), ("empty.json", "", "no_cases"), ("none.json", "", "no_cases"),
        ("odd.json", "b", "interval_not_a_pair"), ("other.json", "", "unsupported_version"),
    ]


def test_report_folders(spark, tmp_path):
    metrics = evaluation.case_metrics(
        spark.createDataFrame([("a", 0.5, 2000), ("a", 0.5, 9000)], "case_id STRING, threshold DOUBLE, captured_ms BIGINT"),
        spark.createDataFrame([("a", 0, 1000, 3000)], "case_id STRING, idx BIGINT, start_ms BIGINT, end_ms BIGINT"),
        spark.createDataFrame([("a", 10_000), ("b", 10_000)], "case_id STRING, duration_ms BIGINT"),
        [0.5],
    )
    events = spark.createDataFrame([("a", "confirmed", 2000)], "case_id STRING, state STRING, captured_ms BIGINT")
    sinks.write_case_reports(metrics, events, str(tmp_path / "r"), folders=True)
    (report,) = (tmp_path / "r" / "reports" / "case=a").glob("*.json")
    body = json.loads(report.read_text())
    assert body["schema_version"] == 1 and body["case_id"] == "a"
    assert body["threshold_results"][0]["interval_recall"] == 1.0
    assert body["threshold_results"][0]["latencies_ms"] == [1000]
    (nothing,) = (tmp_path / "r" / "reports" / "case=b").glob("*.json")
    assert json.loads(nothing.read_text())["threshold_results"][0]["interval_recall"] is None
    assert (tmp_path / "r" / "events" / "case=a").is_dir()


def test_no_sink_takes_vectors(spark, tmp_path):
    df = spark.range(1).withColumn("embedding", F.array(F.lit(1.0)))
    with pytest.raises(ValueError):
        sinks.without_vectors(df)
    with pytest.raises(ValueError):
        eventlog.to_event_log(df, ["id"], ["embedding"])


def test_event_numbers_and_replay(spark):
    rows = [("s", 30, "b", 2), ("s", 10, "a", 1), ("s", 30, "c", 3), ("t", 5, "a", 1)]
    log = eventlog.to_event_log(
        spark.createDataFrame(rows, "search_id STRING, occurred_at BIGINT, type STRING, ord INT"), ["ord"], ["ord"], size=7
    )
    mine = [(r.search_id, r.seq, r.type) for r in eventlog.replay(log, 1).collect()]
    assert mine == [("s", 2, "b"), ("s", 3, "c")]
    kept = eventlog.retain_last(log, 2).where("search_id = 's'")
    assert sorted(r.seq for r in kept.collect()) == [2, 3]
    assert eventlog.replay(log, -5).count() == 4


def test_limit_applies_before_the_shuffle(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.range(100).selectExpr("id % 3 AS search_id", "id AS seq").write.parquet(path)
    plan = eventlog.retain_last(spark.read.parquet(path), 30)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_batch_reconciliation(spark):
    ok = '[{"name": "A", "image_filename": "a.jpg"}, {"name": "B", "image_filename": "b.jpg"}]'
    batches = spark.createDataFrame(
        [(1, ok), (2, "nonsense"), (3, "[]"), (4, ok), (5, '[{"name": 5, "image_filename": "a.jpg"}]'),
         (6, '[{"name": "A", "image_filename": "a.jpg"}, {"name": "B", "image_filename": "a.jpg"}]'), (7, ok),
         (8, "[" + ", ".join(['{"name": "A", "image_filename": "a.jpg"}'] * 21) + "]"), (9, '["a"]')],
        "batch_id INT, targets STRING",
    )
    uploads = spark.createDataFrame(
        [(1, "x/a.jpg"), (1, "b.jpg"), (4, "a.jpg"), (5, "a.jpg"), (6, "a.jpg"), (6, "b.jpg"), (7, "a.jpg"), (7, "c.jpg"), (9, "a.jpg")],
        "batch_id INT, filename STRING",
    )
    checked, matched = admission.reconcile_batch(batches, uploads)
    assert {r.batch_id: r.error_code for r in checked.collect()} == {
        1: None, 2: "invalid_batch_request", 3: "invalid_targets", 4: "image_target_mismatch", 5: "invalid_targets",
        6: "invalid_targets", 7: "image_target_mismatch", 8: "too_many_targets", 9: "invalid_targets",
    }
    assert sorted((r.batch_id, r.filename, r.name) for r in matched.collect()) == [(1, "a.jpg", "A"), (1, "b.jpg", "B")]


def test_status_changes(spark):
    rows = [(1, 1, "initializing", None), (1, 2, "running", None), (1, 3, "running", None), (1, 4, "source_lost", "x"),
            (1, 5, "source_lost", "y"), (1, 6, "completed", None), (1, 7, "running", None), (2, 1, "running", None)]
    log = spark.createDataFrame(rows, "search_id INT, seq BIGINT, status STRING, error STRING")
    assert sorted((r.search_id, r.seq) for r in eventlog.collapse_status(log).collect()) == [(1, 2), (1, 4), (1, 5), (1, 6), (2, 1)]
    assert {r.search_id: r.status for r in eventlog.search_status(log).collect()} == {1: "completed", 2: "stopped"}
    assert {r.search_id: r.status for r in eventlog.search_status(log, ended=False).collect()} == {1: "completed", 2: "running"}


@pytest.mark.parametrize(
    "schema",
    [
        "a BIGINT, embedding ARRAY<DOUBLE>",
        "a BIGINT, faces ARRAY<STRUCT<quality: DOUBLE, v: ARRAY<FLOAT>>>",
        "a BIGINT, faces ARRAY<STRUCT<quality: DOUBLE, embedding: BINARY>>",
        "a BIGINT, m MAP<STRING, ARRAY<FLOAT>>",
    ],
)
def test_vectors_are_refused_at_any_depth(spark, schema):
    with pytest.raises(ValueError, match="vectors"):
        sinks.without_vectors(spark.createDataFrame([], schema))


def test_scratch_needs_a_shared_folder_beyond_one_process():
    class Session:
        class conf:  # noqa: N801
            @staticmethod
            def get(name, default):
                return default

        class sparkContext:  # noqa: N801
            master = "local-cluster[3,2,1024]"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session)


def test_pictures_that_are_missing_or_broken(spark):
    picture = (2, 2, 1, bytearray([10, 20, 30, 40]))
    images = spark.createDataFrame(
        [(1, picture), (2, None)],
        "photo LONG, image STRUCT<height: INT, width: INT, nChannels: INT, data: BINARY>",
    )
    faces = spark.createDataFrame(
        [(1, 0.0, 0.0, 2.0, 2.0), (2, 0.0, 0.0, 2.0, 2.0), (3, 0.0, 0.0, 2.0, 2.0)],
        "photo LONG, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE",
    )
    got = {r.photo: r for r in quality.crop_metrics(faces, images, ["photo"]).collect()}
    assert (got[1].face_width, got[1].brightness) == (2, 25.0)
    assert all(got[i].face_width is None and got[i].blur_variance is None for i in (2, 3))
    found = models.infer_detections(images, ["photo"], lambda: lambda pixels: [])
    assert found.collect() == []


@pytest.mark.parametrize(
    ("values", "code"),
    [([], NO_THRESHOLD), ([0.2, 1.5], THRESHOLD_RANGE), ([float("nan")], THRESHOLD_RANGE), ([0.2, 0.2], THRESHOLD_REPEATED)],
)
def test_thresholds(values, code):
    assert check_thresholds([0.5, -1, 1]) == (0.5, -1.0, 1.0)
    with pytest.raises(ValueError, match=code):
        check_thresholds(values)


def test_files_written_by_tasks(spark, tmp_path):
    """A file per row by Spark's text writer, each in a folder of its own, took most of the time of many."""
    rows = [(f"part-{i % 3}/{i}.bin", bytes([i, 10, 255, 0])) for i in range(50)]
    files = spark.createDataFrame(rows, "path STRING, data BINARY").repartition(5)
    for base in (str(tmp_path / "out"), f"file://{tmp_path}/out"):
        assert sinks.write_files(files, base) == 50
        found = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").glob("*/*")}
        assert found == dict(rows)
    assert sinks.write_files(files.limit(0), str(tmp_path / "none")) == 0
    assert sinks.local_path("hdfs://host/x") is None
    with pytest.raises(ValueError, match="mounted"):
        sinks.write_files(files, "hdfs://host/x")


def test_long_files_are_summed_in_steps(spark, tmp_path, monkeypatch):
    import hashlib
    import random

    from sightmatch.sources import readers

    rng = random.Random(7)
    noise = rng.randbytes(40_000)
    kinds = {
        "noise": noise, "ends": noise + b"\n", "two": noise + b"\n\n", "blank": b"\n" * 9_000, "none": b"x" * 9_000,
        "mark": b"\xef\xbb\xbf" + noise, "mark_ends": b"\xef\xbb\xbf" + noise + b"\n", "dos": b"a\r\n" * 5_000,
        "short": b"abc", "packed.gz": noise[:3_000],
        "a [1]+%20.bin": noise[::-1],
    }
    for name, data in kinds.items():
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(readers, "HASH_BYTES", 4_000)
    monkeypatch.setattr(readers.sums, "PIECE_BYTES", 700)
    # No file above this is held whole.
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "4000")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        got = {r.filename: (r.length, r.sha256) for r in readers.read_files(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {k: (len(d), hashlib.sha256(d).hexdigest()) for k, d in kinds.items()}
