"""Queries over what users hand in."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from catalog.vision import r8
from sightmatch.operators import admission, quality, searches
from sightmatch.params import ENROLMENT
from sightmatch.plans import pipelines
from sightmatch.sources import derived


def _sources(spark, sf):
    return derived.table(spark, sf, "pages").select(
        "page_id",
        F.expr(
            "CASE page_id%5 WHEN 0 THEN 'file' WHEN 1 THEN 'camera' WHEN 4 THEN 'usb' ELSE 'rtsp' END"
        ).alias("type"),
        F.expr(
            "CASE WHEN page_id%7 = 6 THEN NULL WHEN page_id%7 = 5 THEN ''"
            " WHEN page_id%3 = 0 THEN concat('RTSP://user:secret@', regexp_extract(url, '//([^/]+)', 1), ':8554/cam?x=', page_id)"
            " WHEN page_id%3 = 1 THEN concat('rtsps', regexp_replace(url, '^[a-z]+', '')) ELSE url END"
        ).alias("uri"),
        F.expr("CASE WHEN page_id%4 < 3 THEN CAST(page_id%4 AS INT) - 1 END").alias("device_index"),
    )


_SOURCES = """
 SELECT page_id, CASE page_id%5 WHEN 0 THEN 'file' WHEN 1 THEN 'camera' WHEN 4 THEN 'usb' ELSE 'rtsp' END AS type,
   CASE WHEN page_id%7 = 6 THEN NULL WHEN page_id%7 = 5 THEN ''
     WHEN page_id%3 = 0 THEN 'RTSP://user:secret@' || regexp_extract(url, '//([^/]+)', 1) || ':8554/cam?x=' || page_id
     WHEN page_id%3 = 1 THEN 'rtsps' || regexp_replace(url, '^[a-z]+', '') ELSE url END AS uri,
   CASE WHEN page_id%4 < 3 THEN page_id%4 - 1 END AS device_index,
   regexp_extract(url, '//([^/]+)', 1) AS host, regexp_extract(url, '^([a-z]+)', 1) AS plain FROM pages"""


def mask_sources(spark, sf):
    return admission.mask_sources(_sources(spark, sf)).select("page_id", "type", "uri")


def validate_sources(spark, sf):
    return admission.validate_sources(_sources(spark, sf)).select("page_id", "error_code")


def _names(spark, sf):
    return derived.table(spark, sf, "customer").select(
        "c_custkey",
        F.expr(
            "CASE WHEN c_custkey%5 = 0 THEN '   ' WHEN c_custkey%7 = 0 THEN repeat(c_name, 6)"
            " ELSE concat('  ', c_name, ' ') END"
        ).alias("name"),
    )


def clean_targets(spark, sf):
    return admission.clean_targets(_names(spark, sf))


def _requests(spark, sf):
    return derived.table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey%23 = 0 THEN cast(array() AS array<bigint>)"
        " ELSE sequence(1L, 1 + o_orderkey%24) END AS target_ids",
        "CASE WHEN o_orderkey%5 > 0 THEN o_orderkey%5 - 1.5D END AS timeout_s",
        "repeat('r', CAST(o_orderkey%140 AS INT)) AS request_id",
    )


def validate_requests(spark, sf):
    return admission.validate_requests(_requests(spark, sf)).select("o_orderkey", "error_code")


def _uploads(spark, sf):
    return derived.table(spark, sf, "pages").selectExpr(
        "page_id",
        "CASE page_id%6 WHEN 0 THEN 'image/gif' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/webp' ELSE 'image/jpeg' END AS content_type",
        "CAST(char_length(html) AS BIGINT) * 9000 AS length",
        "CASE WHEN page_id%11 = 0 THEN -1 ELSE CAST(char_length(html) AS INT) * 4 END AS width",
        "CASE WHEN page_id%13 = 0 THEN NULL ELSE CAST(char_length(url) AS INT) * 60 END AS height",
    )


def admit_uploads(spark, sf):
    admitted = admission.admit_uploads(_uploads(spark, sf))
    return admitted.select("page_id", "error_code", F.col("status").cast("bigint").alias("status"))


def mask_errors(spark, sf):
    e = derived.table(spark, sf, "events").selectExpr(
        "event_id",
        "CASE event_type WHEN 'error' THEN 'ModelUnavailableError' WHEN 'view' THEN 'ValueError' ELSE 'OSError' END AS error_type",
        "concat('cannot load ', props) AS message",
    )
    return admission.mask_errors(e).select("event_id", "error")


def label_tracks(spark, sf):
    e = derived.frames(spark, sf).selectExpr(
        "event_id",
        "CASE event_type WHEN 'purchase' THEN 'confirmed' WHEN 'click' THEN 'candidate' ELSE 'tracking' END AS state",
        "k/100.0D AS similarity",
    )
    return admission.label_tracks(e).select("event_id", "label")


# Every frame is a photo with none, one or two faces; some faces have no usable vector.
def _photos(spark, sf):
    f = derived.faces(spark, sf).withColumn(
        "photo_id", F.col("source_id") * 1000 + F.col("frame_id")
    )
    photos = f.selectExpr(
        "source_id AS search_id",
        "photo_id",
        "CASE WHEN photo_id%19 = 0 THEN ' ' ELSE concat(' photo ', CAST(photo_id AS STRING)) END AS name",
    )
    faces = (
        f.where("photo_id%5 <> 0")
        .withColumn(
            "j",
            F.explode(F.expr("sequence(0, CASE WHEN photo_id%5 = 4 THEN 1 ELSE 0 END)")),
        )
        .withColumn(
            "embedding",
            F.expr(
                "CASE WHEN photo_id%7 = 3 AND j = 0 THEN transform(embedding, x -> cast(0 AS float))"
                " ELSE embedding END"
            ),
        )
    )
    return photos, quality.assess(faces, ENROLMENT)


def enroll(spark, sf):
    photos, faces = _photos(spark, sf)
    done = admission.enroll(photos, faces, "stub")
    return done.select(
        "photo_id",
        "name",
        "error_code",
        "error",
        F.col("face_width").cast("bigint").alias("face_width"),
        F.col("face_height").cast("bigint").alias("face_height"),
        *r8("quality_score"),
    )


_ENROLLED = """
 SELECT search_id, photo_id, trim(name) AS name, CASE WHEN trim(name) = '' THEN 'invalid_target_name' WHEN n = 0 THEN 'no_face'
     WHEN n > 1 THEN 'multiple_faces' WHEN reasons <> '' THEN 'face_quality_low' END AS error_code, reasons, w, h, quality
 FROM (
   SELECT *, source_id AS search_id, source_id*1000 + frame_id AS photo_id,
     CASE WHEN (source_id*1000+frame_id)%19 = 0 THEN ' ' ELSE ' photo ' || (source_id*1000+frame_id) END AS name,
     CASE (source_id*1000+frame_id)%5 WHEN 0 THEN 0 WHEN 4 THEN 2 ELSE 1 END
       - CASE WHEN (source_id*1000+frame_id)%5 <> 0 AND (source_id*1000+frame_id)%7 = 3 THEN 1 ELSE 0 END AS n,
     (x2-x1)::BIGINT AS w, (y2-y1)::BIGINT AS h,
     array_to_string(list_filter([CASE WHEN least(x2-x1, y2-y1) < 100 THEN 'face_too_small' END,
       CASE WHEN detection_score < 0.6 THEN 'detection_score_low' END, CASE WHEN blur_variance < 5 THEN 'face_blurry' END,
       CASE WHEN brightness < 35 OR brightness > 225 THEN 'face_exposure_bad' END], lambda r: r IS NOT NULL), ', ') AS reasons,
     0.25*detection_score + 0.25*least(1.0, least(x2-x1, y2-y1)/150.0) + 0.27*least(1.0, blur_variance/10.0)
       + 0.15*greatest(0.0, 1.0-abs(brightness-130.0)/130.0) + 0.08 AS quality FROM faces)"""


def enrolled(spark, sf):
    """The searches whose photos all gave a target."""
    photos, faces = _photos(spark, sf)
    good, bad = pipelines.enrolled(photos, faces, "stub")
    return (
        bad.groupBy("search_id")
        .agg(F.count(F.lit(1)).alias("n_bad"))
        .join(good.groupBy("search_id").agg(F.count(F.lit(1)).alias("n_targets")), "search_id", "full")
    )


# A batch per order, a declared target per line; some lists are broken, some files missing.
def _batches(spark, sf):
    lines = derived.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    spec = (
        "CASE WHEN l_partkey%97 = 0 THEN concat('{\"name\": ', l_partkey, ', \"image_filename\": \"', l_linenumber, '.jpg\"}')"
        " WHEN l_partkey%89 = 0 THEN concat('{\"name\": \"p', l_partkey, '\", \"image_filename\": \" \"}')"
        " ELSE concat('{\"name\": \"p', l_partkey, '\", \"image_filename\": \"', l_linenumber, '.jpg\"}') END"
    )
    batches = (
        lines.withColumn("spec", F.expr(spec))
        .groupBy(F.col("l_orderkey").alias("batch_id"))
        .agg(F.array_join(F.sort_array(F.collect_list("spec")), ", ").alias("specs"))
        .selectExpr(
            "batch_id",
            "CASE WHEN batch_id%31 = 0 THEN '[{' WHEN batch_id%29 = 0 THEN '[]' WHEN batch_id%37 = 0 THEN '{}'"
            " ELSE concat('[', specs, ']') END AS targets",
        )
    )
    uploads = lines.where("NOT (l_orderkey%7 = 0 AND l_linenumber = 1)").selectExpr(
        "l_orderkey AS batch_id",
        "CASE WHEN l_orderkey%11 = 0 AND l_linenumber = 2 THEN 'other.jpg'"
        " ELSE concat('upload/', l_linenumber, '.jpg') END AS filename",
    )
    return batches, uploads


def reconcile_batch(spark, sf):
    checked, _ = admission.reconcile_batch(*_batches(spark, sf))
    return checked.select(
        "batch_id", "n_files", F.col("n_specs").cast("bigint").alias("n_specs"), "error_code"
    )


def reconciled_targets(spark, sf):
    _, matched = admission.reconcile_batch(*_batches(spark, sf))
    return matched.select("batch_id", "filename", "name")


_SPECS = """
 SELECT l_orderkey AS batch_id, l_linenumber AS line, l_partkey AS part,
   CASE WHEN l_partkey%97 = 0 THEN l_linenumber || '.jpg' WHEN l_partkey%89 = 0 THEN ' ' ELSE l_linenumber || '.jpg' END AS filename,
   l_partkey%97 = 0 OR l_partkey%89 = 0 AS bad FROM lineitem"""
_FILES = """
 SELECT l_orderkey AS batch_id, CASE WHEN l_orderkey%11 = 0 AND l_linenumber = 2 THEN 'other.jpg' ELSE l_linenumber || '.jpg' END AS filename
 FROM lineitem WHERE NOT (l_orderkey%7 = 0 AND l_linenumber = 1)"""
_CHECKED = """
 SELECT batch_id, coalesce(n_files, 0) AS n_files, CASE WHEN broken OR empty THEN 0 ELSE n END AS n_specs,
   CASE WHEN broken THEN 'invalid_batch_request' WHEN empty THEN 'invalid_targets' WHEN n > 20 THEN 'too_many_targets'
     WHEN coalesce(n_files, 0) <> n THEN 'image_target_mismatch' WHEN bad OR names < n THEN 'invalid_targets'
     WHEN unknown > 0 THEN 'image_target_mismatch' END AS error_code
 FROM (SELECT batch_id, batch_id%31 = 0 AS broken, batch_id%29 = 0 OR batch_id%37 = 0 AS empty, count(*) AS n, bool_or(bad) AS bad,
         count(DISTINCT filename) AS names FROM specs GROUP BY batch_id)
 LEFT JOIN (SELECT batch_id, count(*) AS n_files, count(*) FILTER (WHERE NOT EXISTS (
     SELECT 1 FROM specs s WHERE s.batch_id = files.batch_id AND s.filename = files.filename)) AS unknown
   FROM files GROUP BY batch_id) USING (batch_id)"""


def check_targets(spark, sf):
    requests = derived.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("target_id")
    )
    known = derived.table(spark, sf, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("target_id")
    )
    return searches.check_targets(requests, known)


def _search_requests(spark, sf):
    return derived.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS search_id",
        "o_orderkey AS ord",
        "CASE WHEN o_orderkey%9 = 0 THEN NULL WHEN o_orderkey%9 = 1 THEN '' ELSE CAST(o_custkey AS STRING) END AS request_id",
    )


def lookup_requests(spark, sf):
    keys = derived.table(spark, sf, "customer").selectExpr(
        "CASE WHEN c_custkey%10 = 0 THEN concat('  ', ' ') WHEN c_custkey%3 = 0 THEN concat(' ', CAST(c_custkey AS STRING), ' ')"
        " ELSE CAST(c_custkey AS STRING) END AS request_id"
    )
    return searches.lookup_requests(keys, _search_requests(spark, sf))


def dedupe_requests(spark, sf):
    done = searches.dedupe_requests(_search_requests(spark, sf))
    return done.select("ord", "request_id", "search_id")


def timed_requests(spark, sf):
    """Requests at the time of their order, and when their searches would end, some never."""
    days = derived.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("search_id"),
        (F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint") * 86_400_000).alias("at_ms"),
    )
    requests = _search_requests(spark, sf).join(days, "search_id")
    ends = requests.where("search_id % 5 <> 0").selectExpr(
        "request_id", "search_id", "at_ms + (search_id % 11)*50*86400000 AS ended_at"
    )
    return requests.select("request_id", "search_id", "ord", "at_ms"), ends


def answer_requests(spark, sf):
    requests, ends = timed_requests(spark, sf)
    return searches.answer_requests(requests, ends)


# A request id's requests in order, with the search that is active after each.
ANSWER_SQL = """
WITH RECURSIVE reqs AS ({reqs}),
timed AS (
 SELECT r.*, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 86400000 AS at_ms,
   CASE WHEN search_id % 5 <> 0 AND search_id % 11 > 0 THEN (search_id % 11)*50*86400000 END AS lasts
 FROM reqs r JOIN orders ON o_orderkey = search_id),
named AS (
 SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY at_ms, search_id) AS n FROM timed
 WHERE request_id <> ''),
walk AS (
 SELECT request_id, search_id AS ord, at_ms, n, search_id AS active, at_ms + lasts AS until FROM named WHERE n = 1
 UNION ALL
 SELECT r.request_id, r.search_id, r.at_ms, r.n, CASE WHEN r.at_ms >= w.until THEN r.search_id ELSE w.active END,
   CASE WHEN r.at_ms >= w.until THEN r.at_ms + r.lasts ELSE w.until END
 FROM walk w JOIN named r ON r.request_id = w.request_id AND r.n = w.n + 1)
SELECT request_id, active AS search_id, ord, CAST(at_ms AS BIGINT) AS at_ms FROM walk
UNION ALL SELECT request_id, search_id, search_id, CAST(at_ms AS BIGINT) FROM timed WHERE coalesce(request_id, '') = ''"""

_SEARCH_REQUESTS = """
 SELECT o_orderkey AS search_id, CASE WHEN o_orderkey%9 = 0 THEN NULL WHEN o_orderkey%9 = 1 THEN ''
   ELSE CAST(o_custkey AS VARCHAR) END AS request_id FROM orders"""

QUERIES = {
    "mask_sources": (
        mask_sources,
        v.sql(
            """
 SELECT page_id, type, CASE WHEN type <> 'rtsp' OR uri IS NULL OR uri = '' THEN uri
   WHEN page_id%3 = 0 THEN 'rtsp://' || lower(host) || ':8554/***' WHEN page_id%3 = 1 THEN 'rtsps://' || lower(host) || '/***'
   ELSE plain || '://' || lower(host) || '/***' END AS uri FROM sources""",
            sources=_SOURCES,
        ),
    ),
    "validate_sources": (
        validate_sources,
        v.sql(
            """
 SELECT page_id, CASE WHEN type = 'usb' OR device_index < 0 OR (type <> 'camera' AND (uri IS NULL OR uri = ''))
     OR (type = 'camera' AND device_index IS NULL) THEN 'validation_error'
   WHEN type = 'file' OR (type = 'rtsp' AND page_id%3 = 2) THEN 'invalid_source' END AS error_code FROM sources""",
            sources=_SOURCES,
        ),
    ),
    "clean_targets": (
        clean_targets,
        """
 SELECT c_custkey, CASE WHEN c_custkey%5 = 0 THEN '' WHEN c_custkey%7 = 0 THEN repeat(c_name, 6) ELSE c_name END AS name,
   CASE WHEN c_custkey%5 = 0 OR c_custkey%7 = 0 THEN 'invalid_target_name' END AS error_code FROM customer""",
    ),
    "validate_requests": (
        validate_requests,
        """
 SELECT o_orderkey, CASE WHEN o_orderkey%23 = 0 THEN 'invalid_targets' WHEN o_orderkey%24 >= 20 THEN 'too_many_targets'
   WHEN o_orderkey%5 = 1 THEN 'invalid_timeout' WHEN o_orderkey%140 > 128 THEN 'validation_error' END AS error_code FROM orders""",
    ),
    "admit_uploads": (
        admit_uploads,
        """
 SELECT page_id, error_code, CASE error_code WHEN 'unsupported_media_type' THEN 415 WHEN 'image_too_large' THEN 413
   WHEN 'image_decode_failed' THEN 422 END::BIGINT AS status FROM (
   SELECT page_id, CASE WHEN page_id%6 = 0 THEN 'unsupported_media_type' WHEN length(html)*9000 > 10485760 THEN 'image_too_large'
     WHEN page_id%11 = 0 OR page_id%13 = 0 THEN 'image_decode_failed'
     WHEN length(html)*4*length(url)*60 > 20000000 THEN 'image_too_large' END AS error_code FROM pages)""",
    ),
    "mask_errors": (
        mask_errors,
        """
 SELECT event_id, CASE event_type WHEN 'error' THEN 'cannot load ' || props WHEN 'view' THEN 'ValueError: processing failed'
   ELSE 'OSError: processing failed' END AS error FROM events""",
    ),
    "label_tracks": (
        label_tracks,
        v.sql(
            """
 SELECT event_id, CASE event_type WHEN 'purchase' THEN 'FOUND  ' ELSE 'CANDIDATE  ' END || printf('%.2f', k/100.0) AS label
 FROM frames WHERE event_type IN ('purchase', 'click')"""
        ),
    ),
    "enroll": (
        enroll,
        v.sql(
            """
 SELECT photo_id, name, error_code,
   CASE WHEN error_code = 'face_quality_low' THEN 'face quality is too low: ' || reasons END AS error,
   CASE WHEN error_code IS NULL THEN w END AS face_width, CASE WHEN error_code IS NULL THEN h END AS face_height,
   CASE WHEN error_code IS NULL THEN round(quality, 8) END AS quality_score FROM enrolled""",
            enrolled=_ENROLLED,
        ),
    ),
    "enrolled_searches": (
        enrolled,
        v.sql(
            """
 SELECT search_id, CASE WHEN count(error_code) > 0 THEN count(error_code) END AS n_bad,
   CASE WHEN count(error_code) = 0 THEN count(*) END AS n_targets FROM enrolled GROUP BY search_id""",
            enrolled=_ENROLLED,
        ),
    ),
    "reconcile_batch": (
        reconcile_batch,
        v.sql("SELECT * FROM checked", specs=_SPECS, files=_FILES, checked=_CHECKED),
    ),
    "reconciled_targets": (
        reconciled_targets,
        v.sql(
            """
 SELECT f.batch_id, f.filename, 'p' || s.part AS name FROM files f JOIN specs s USING (batch_id, filename)
 JOIN checked c USING (batch_id) WHERE c.error_code IS NULL""",
            specs=_SPECS,
            files=_FILES,
            checked=_CHECKED,
        ),
    ),
    "check_targets": (
        check_targets,
        """
 SELECT o_orderkey AS request_id, o_custkey AS target_id, 'target_not_found' AS error_code FROM orders
 WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
    ),
    "lookup_requests": (
        lookup_requests,
        v.sql(
            """
 SELECT CASE WHEN c_custkey%10 = 0 THEN '   ' WHEN c_custkey%3 = 0 THEN ' ' || c_custkey || ' '
     ELSE CAST(c_custkey AS VARCHAR) END AS request_id, CASE WHEN c_custkey%10 <> 0 THEN f.search_id END AS search_id
 FROM customer c LEFT JOIN (SELECT request_id, min(search_id) AS search_id FROM reqs GROUP BY request_id) f
   ON f.request_id = CAST(c_custkey AS VARCHAR)""",
            reqs=_SEARCH_REQUESTS,
        ),
    ),
    "answer_requests": (answer_requests, ANSWER_SQL.format(reqs=_SEARCH_REQUESTS)),
    "dedupe_requests": (
        dedupe_requests,
        v.sql(
            """
 SELECT search_id AS ord, request_id, CASE WHEN request_id IS NULL OR request_id = '' THEN search_id
   ELSE min(search_id) OVER (PARTITION BY request_id) END AS search_id FROM reqs""",
            reqs=_SEARCH_REQUESTS,
        ),
    ),
}
