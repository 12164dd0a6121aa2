"""Checks on what users hand in: sources, names, requests, uploads, batches, photos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightmatch.functions import text, vectors
from sightmatch.params import (
    LIVE_SCHEMES,
    MAX_BATCH_TARGETS,
    MAX_IMAGE_PIXELS,
    MAX_REQUEST_ID_CHARS,
    MAX_UPLOAD_BYTES,
    UPLOAD_TYPES,
)


def first_error(*rules: tuple[Column, str]) -> Column:
    """Code of the first rule that is broken; null when none is."""
    return F.coalesce(*[F.when(broken, F.lit(code)) for broken, code in rules])


def mask_sources(sources: DataFrame) -> DataFrame:
    """Stream addresses without user, password, path and query; other sources unchanged."""
    stream = (F.col("type") == "rtsp") & (F.coalesce(F.col("uri"), F.lit("")) != "")
    return sources.withColumn(
        "uri", F.when(stream, text.mask_uri(F.col("uri"))).otherwise(F.col("uri"))
    )


def clean_targets(targets: DataFrame, col: str = "name") -> DataFrame:
    """Trimmed names; error_code where a name is blank or too long."""
    return targets.withColumn("error_code", text.name_error(F.col(col))).withColumn(
        col, text.strip(F.col(col))
    )


def validate_sources(
    sources: DataFrame, *, live: bool = True, shape_code: str = "validation_error"
) -> DataFrame:
    """error_code of sources(type, uri, device_index).

    Malformed ones get `shape_code` ("invalid_source" in batch requests); a live search also
    refuses files and stream schemes other than rtsp and rtsps.
    """
    kind, uri, device = F.col("type"), F.col("uri"), F.col("device_index")
    no_uri = F.coalesce(uri, F.lit("")) == ""
    rules = [
        (F.coalesce(~kind.isin("rtsp", "camera", "file"), F.lit(True)), shape_code),
        (device < 0, shape_code),
        (kind.isin("rtsp", "file") & no_uri, shape_code),
        ((kind == "camera") & device.isNull(), shape_code),
    ]
    if live:
        rules += [
            (kind == "file", "invalid_source"),
            (
                (kind == "rtsp") & ~text.scheme(uri).isin(*LIVE_SCHEMES),
                "invalid_source",
            ),
        ]
    return sources.withColumn("error_code", first_error(*rules))


def validate_requests(requests: DataFrame) -> DataFrame:
    """error_code of requests(target_ids ARRAY, timeout_s, request_id)."""
    n = F.coalesce(F.size("target_ids"), F.lit(0))
    return requests.withColumn(
        "error_code",
        first_error(
            (n <= 0, "invalid_targets"),
            (n > MAX_BATCH_TARGETS, "too_many_targets"),
            (F.col("timeout_s") <= 0, "invalid_timeout"),
            (F.char_length("request_id") > MAX_REQUEST_ID_CHARS, "validation_error"),
        ),
    )


def admit_uploads(uploads: DataFrame) -> DataFrame:
    """error_code and status of uploads(content_type, length, width, height); a picture that
    could not be decoded has no width or height, or negative ones."""
    pixels = F.col("width").cast("bigint") * F.col("height")
    code = first_error(
        (
            F.coalesce(~F.col("content_type").isin(*UPLOAD_TYPES), F.lit(True)),
            "unsupported_media_type",
        ),
        (F.col("length") > MAX_UPLOAD_BYTES, "image_too_large"),
        (
            F.coalesce((F.col("width") < 0) | (F.col("height") < 0), F.lit(True)),
            "image_decode_failed",
        ),
        (pixels > MAX_IMAGE_PIXELS, "image_too_large"),
    )
    status = (
        F.when(F.col("error_code") == "unsupported_media_type", 415)
        .when(F.col("error_code") == "image_too_large", 413)
        .when(F.col("error_code") == "image_decode_failed", 422)
    )
    return uploads.withColumn("error_code", code).withColumn("status", status)


def mask_errors(df: DataFrame) -> DataFrame:
    """Add `error` from error_type and message, without details that could leak."""
    return df.withColumn("error", text.safe_error(F.col("error_type"), F.col("message")))


def label_tracks(df: DataFrame) -> DataFrame:
    """Display label of tracks that are confirmed or candidates; the others are not shown."""
    labelled = df.withColumn("label", text.track_label(F.col("state"), F.col("similarity")))
    return labelled.where("label IS NOT NULL")


def enroll(photos: DataFrame, faces: DataFrame, model: str) -> DataFrame:
    """One row per photo(search_id, photo_id, name): a target, or why there is none.

    `faces` are assessed with the enrolment profile and include rejected ones; faces without
    a usable vector count as not seen at all.
    """
    seen = faces.where(vectors.is_valid(F.col("embedding")))
    counts = seen.groupBy("photo_id").agg(F.count(F.lit(1)).alias("n_faces"))
    single = seen.join(counts.where("n_faces = 1"), "photo_id", "left_semi").select(
        "photo_id",
        F.col("x1").alias("_x1"),
        F.col("y1").alias("_y1"),
        F.col("x2").alias("_x2"),
        F.col("y2").alias("_y2"),
        "detection_score",
        F.col("quality").alias("quality_score"),
        "accepted",
        "rejection_reasons",
        vectors.normalized(F.col("embedding")).alias("embedding"),
    )
    found = photos.join(counts, "photo_id", "left").join(single, "photo_id", "left")
    n = F.coalesce(F.col("n_faces"), F.lit(0))
    checked = clean_targets(found).withColumn(
        "error_code",
        F.coalesce(
            F.col("error_code"),
            first_error(
                (n == 0, "no_face"),
                (n > 1, "multiple_faces"),
                (~F.col("accepted"), "face_quality_low"),
                (F.col("embedding").isNull(), "invalid_embedding"),
            ),
        ),
    )
    ok = F.col("error_code").isNull()
    reasons = F.concat(
        F.lit("face quality is too low: "), F.array_join("rejection_reasons", ", ")
    )
    return checked.select(
        *photos.columns,
        "error_code",
        F.when(F.col("error_code") == "face_quality_low", reasons).alias("error"),
        F.when(ok, (F.col("_x2") - F.col("_x1")).cast("int")).alias("face_width"),
        F.when(ok, (F.col("_y2") - F.col("_y1")).cast("int")).alias("face_height"),
        F.when(ok, F.col("detection_score")).alias("detection_score"),
        F.when(ok, F.col("quality_score")).alias("quality_score"),
        F.when(ok, F.lit(model)).alias("model"),
        F.when(ok, F.col("embedding")).alias("embedding"),
    )


def reconcile_batch(batches: DataFrame, uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declared targets against uploaded files.

    `batches(batch_id, targets)` holds the JSON text of a request, `uploads(batch_id,
    filename)` its files.  Returns the batches with error_code, and the matched
    (batch_id, filename, name) of the batches without one.  Each is one join by batch: requests are
    parsed once, files are shuffled once, and no list of files is made.
    """
    parsed = batches.withColumn("_json", F.try_parse_json("targets")).withColumn(
        "_specs", F.try_variant_get("_json", "$", "array<variant>")
    )

    def string_at(spec: Column, field: str) -> Column:
        value = F.try_variant_get(spec, f"$.{field}", "variant")
        return F.when(
            F.schema_of_variant(value) == "STRING", F.try_variant_get(spec, f"$.{field}", "string")
        )

    fields = F.transform(
        "_specs",
        lambda s: F.struct(
            string_at(s, "name").alias("name"),
            string_at(s, "image_filename").alias("filename"),
        ),
    )
    specs = parsed.select(
        "batch_id",
        F.col("_json").isNull().alias("_no_json"),
        fields.alias("_specs"),
        F.coalesce(F.size("_specs"), F.lit(0)).alias("n_specs"),
    )
    names = F.transform("_specs", lambda s: s["filename"])
    bad_name = F.exists("_specs", lambda s: s["name"].isNull())
    bad_file = F.exists(
        "_names", lambda f: f.isNull() | (text.strip(f) == "")
    ) | (F.size(F.array_distinct("_names")) < F.size("_names"))
    # A list over the limit is refused as it is, so at most MAX_BATCH_TARGETS entries are compared.
    few = F.col("n_specs") <= MAX_BATCH_TARGETS
    judged = (
        specs.withColumn("_specs", F.when(few, F.col("_specs")))
        .withColumn("_names", names)
        .withColumn("_bad", bad_name | bad_file)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    files = uploads.select(
        "batch_id",
        F.regexp_extract("filename", r"([^/]*)/*$", 1).alias("filename"),
        F.lit(True).alias("_file"),
    )
    known = F.coalesce(F.array_contains("_names", F.col("filename")), F.lit(False))
    joined = judged.join(files, "batch_id", "left").withColumn("_unknown", F.col("_file") & ~known)

    def error() -> Column:
        return first_error(
            (F.col("_no_json"), "invalid_batch_request"),
            (F.col("n_specs") <= 0, "invalid_targets"),
            (F.col("n_specs") > MAX_BATCH_TARGETS, "too_many_targets"),
            (F.col("n_files") != F.col("n_specs"), "image_target_mismatch"),
            (F.col("_bad"), "invalid_targets"),
            (F.col("_unknown"), "image_target_mismatch"),
        )

    told = ["_no_json", "n_specs", "_bad"]
    counts = [F.count("_file").alias("n_files"), F.max("_unknown").alias("_unknown")]
    checked = (
        joined.groupBy("batch_id", "_row")
        .agg(*[F.first(c).alias(c) for c in told], *counts)
        .select("batch_id", "n_specs", "n_files", error().alias("error_code"))
    )
    batch = Window.partitionBy("batch_id", "_row")
    in_good = joined.withColumns(
        {"n_files": F.count("_file").over(batch), "_unknown": F.max("_unknown").over(batch)}
    ).where(error().isNull())
    name = F.element_at(F.filter("_specs", lambda s: s["filename"] == F.col("filename")), 1)["name"]
    return checked, in_good.select("batch_id", "filename", name.alias("name"))
