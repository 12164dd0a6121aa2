"""Queries over vectors, faces and boxes."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import views as v
from sightmatch.functions import vectors
from sightmatch.operators import association, detect, matching, models, quality, tracking
from sightmatch.operators import vectors as vec_ops
from sightmatch.params import ENROLMENT, SEARCH, QualityProfile, TrackerParams
from sightmatch.plans import pipelines
from sightmatch.sources import derived, gallery, readers, sinks
from sightmatch.sources.scratch import cut, fresh_path


def r6(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]


def r8(*names: str):
    """For sums of short decimals, which would fall on the edge of a sixth digit."""
    return [F.round(F.col(n), 8).alias(n) for n in names]


def _scaled(spark, sf):
    """Vectors of other lengths than 1; some zero, some with a NaN, some empty."""
    return derived.table(spark, sf, "embeddings").select(
        "vec_id",
        F.expr(
            "CASE WHEN vec_id%17 = 3 THEN cast(array() AS array<float>)"
            " WHEN vec_id%11 = 0 THEN transform(embedding, x -> cast(0 AS float))"
            " WHEN vec_id%13 = 0 THEN transform(embedding, x -> cast('NaN' AS float))"
            " ELSE transform(embedding, x -> cast(x * (1 + vec_id%7) AS float)) END"
        ).alias("embedding"),
    )


_SCALED_SQL = """
 SELECT vec_id, CASE WHEN vec_id%17 = 3 THEN []::FLOAT[]
   WHEN vec_id%11 = 0 THEN list_transform(embedding, lambda x: 0::FLOAT)
   WHEN vec_id%13 = 0 THEN list_transform(embedding, lambda x: 'NaN'::FLOAT)
   ELSE list_transform(embedding, lambda x: (x * (1 + vec_id%7))::FLOAT) END AS embedding
 FROM embeddings"""


def normalize_vectors(spark, sf):
    valid, _ = vec_ops.split_valid_vectors(_scaled(spark, sf))
    unit = vec_ops.normalize_vectors(valid)
    return unit.select("vec_id", F.posexplode("embedding").alias("pos", "x")).select(
        "vec_id",
        F.col("pos").cast("bigint").alias("pos"),
        F.round(F.col("x").cast("double"), 5).alias("x"),
    )


def invalid_vectors(spark, sf):
    _, invalid = vec_ops.split_valid_vectors(_scaled(spark, sf))
    return invalid.select("vec_id")


def similarity(spark, sf):
    """Each vector against the one before it."""
    e = derived.table(spark, sf, "embeddings").select("vec_id", "embedding")
    before = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("before"))
    return e.join(before, "vec_id").select(
        "vec_id", F.round(vectors.dot(F.col("embedding"), F.col("before")), 6).alias("similarity")
    )


def _posed(spark, sf):
    faces = derived.faces(spark, sf, vectors=False)
    return faces.withColumn(
        "landmarks",
        F.expr(
            "CASE WHEN frame_id%9 <> 4 THEN array("
            " named_struct('x', x1+15, 'y', y1+25+(frame_id%5)*4),"
            " named_struct('x', x1+45+(frame_id%7), 'y', y1+25+(frame_id%3)*9),"
            " named_struct('x', x1+25+(frame_id%11), 'y', y1+50)) END"
        ),
    )


_POSED_SQL = """
 SELECT *, CASE WHEN frame_id%9 <> 4 THEN (30+(frame_id%7))::DOUBLE END AS dx,
   CASE WHEN frame_id%9 <> 4 THEN ((frame_id%3)*9-(frame_id%5)*4)::DOUBLE END AS dy,
   CASE WHEN frame_id%9 <> 4 THEN (x1+25+(frame_id%11)) - (x1+15 + x1+45+(frame_id%7))/2.0 END AS off
 FROM faces"""

_POSE_SQL = """
 SELECT *, degrees(atan2(dy, dx)) AS roll_degrees, off/(greatest(sqrt(dx*dx+dy*dy), 1e-6)/2.0) AS yaw_proxy
 FROM posed"""


def pose(spark, sf):
    return quality.add_pose(_posed(spark, sf)).select(
        "source_id", "frame_id", *r6("roll_degrees", "yaw_proxy")
    )


def _quality(spark, sf, profile):
    faces = quality.add_pose(_posed(spark, sf))
    done = quality.assess(faces, profile, F.lit(v.FRAME_W), F.lit(v.FRAME_H))
    return done.select(
        "source_id",
        "frame_id",
        F.col("face_width").cast("bigint").alias("face_width"),
        F.col("face_height").cast("bigint").alias("face_height"),
        F.array_join("rejection_reasons", ",").alias("reasons"),
        "accepted",
        *r8("quality"),
    )


def _quality_sql(profile):
    pose_rules = ""
    if profile.max_roll is not None:
        pose_rules = f""",
      CASE WHEN abs(roll_degrees) > {profile.max_roll} THEN 'face_roll_too_large' END,
      CASE WHEN abs(yaw_proxy) > {profile.max_yaw} THEN 'face_yaw_too_large' END"""
    sized = f"""
 SELECT *, greatest(0, least({v.FRAME_W}, trunc(x2)::BIGINT) - greatest(0, trunc(x1)::BIGINT)) AS face_width,
   greatest(0, least({v.FRAME_H}, trunc(y2)::BIGINT) - greatest(0, trunc(y1)::BIGINT)) AS face_height
 FROM pose_view"""
    measured = """
 SELECT * EXCLUDE (blur_variance, brightness), least(face_width, face_height) AS side,
   CASE WHEN least(face_width, face_height) = 0 THEN 0.0 ELSE blur_variance END AS blur,
   CASE WHEN least(face_width, face_height) = 0 THEN 0.0 ELSE brightness END AS light FROM sized"""
    judged = f"""
 SELECT *, array_to_string(list_filter([
      CASE WHEN side < {profile.min_side} THEN 'face_too_small' END,
      CASE WHEN detection_score < {profile.min_detection} THEN 'detection_score_low' END,
      CASE WHEN side = 0 THEN 'invalid_face_crop' END,
      CASE WHEN side > 0 AND blur < {profile.min_blur} THEN 'face_blurry' END,
      CASE WHEN side > 0 AND (light < {profile.min_brightness} OR light > {profile.max_brightness})
           THEN 'face_exposure_bad' END{pose_rules}], lambda r: r IS NOT NULL), ',') AS reasons
 FROM measured"""
    body = f"""
 SELECT source_id, frame_id, face_width, face_height, reasons, reasons = '' AS accepted,
   round(least(1.0, greatest(0.0, 0.25*detection_score
     + 0.25*least(1.0, side/{profile.min_side * 1.5})
     + 0.27*least(1.0, blur/{max(profile.min_blur * 2, 1)})
     + 0.15*greatest(0.0, 1.0-abs(light-130.0)/130.0)
     + 0.08*CASE WHEN roll_degrees IS NULL THEN 1.0 ELSE greatest(0.0, 1.0-abs(roll_degrees)/45.0) END
           *CASE WHEN yaw_proxy IS NULL THEN 1.0 ELSE greatest(0.0, 1.0-abs(yaw_proxy)) END)), 8) AS quality
 FROM judged"""
    return v.sql(
        body, posed=_POSED_SQL, pose_view=_POSE_SQL, sized=sized, measured=measured, judged=judged
    )


def rejection_counts(spark, sf):
    return quality.rejection_counts(v.assessed(spark, sf, vectors=False))


def face_diagnostics(spark, sf):
    return quality.face_diagnostics(v.assessed(spark, sf, vectors=False), "source_id")


# Crop boxes over the 8 x 8 pictures, varied by picture.
def crop_metrics(spark, sf):
    faces = derived.table(spark, sf, "embeddings").selectExpr(
        "vec_id",
        "CAST(vec_id%3 AS DOUBLE) - 1.0D AS x1",
        "CAST(vec_id%4 AS DOUBLE) AS y1",
        "5.0D + vec_id%5 AS x2",
        "6.5D + vec_id%3 AS y2",
    )
    done = quality.crop_metrics(faces, v.gray_images(spark, sf), ["vec_id"])
    return done.select(
        "vec_id",
        F.col("face_width").cast("bigint").alias("face_width"),
        F.col("face_height").cast("bigint").alias("face_height"),
        *r6("blur_variance", "brightness"),
    )


_PIXELS = """
 SELECT vec_id, (p-1)%8 AS x, (p-1)//8 AS y, g FROM (
   SELECT vec_id, generate_subscripts(embedding, 1) AS p,
     unnest(list_transform(embedding, lambda e: floor(abs(e::DOUBLE)*1000)::BIGINT % 256)) AS g
   FROM embeddings)"""

_CROP_SQL = v.sql(
    """
 SELECT c.vec_id, any_value(c.r - c.l) AS face_width, any_value(c.b - c.t) AS face_height,
   round(var_pop(n.g + s.g + w.g + e.g - 4.0*p.g), 6) AS blur_variance, round(avg(p.g), 6) AS brightness
 FROM crops c JOIN pixels p ON p.vec_id = c.vec_id AND p.x >= c.l AND p.x < c.r AND p.y >= c.t AND p.y < c.b
 JOIN pixels n ON n.vec_id = c.vec_id AND n.x = p.x AND n.y = CASE WHEN p.y = c.t THEN c.t+1 ELSE p.y-1 END
 JOIN pixels s ON s.vec_id = c.vec_id AND s.x = p.x AND s.y = CASE WHEN p.y = c.b-1 THEN c.b-2 ELSE p.y+1 END
 JOIN pixels w ON w.vec_id = c.vec_id AND w.y = p.y AND w.x = CASE WHEN p.x = c.l THEN c.l+1 ELSE p.x-1 END
 JOIN pixels e ON e.vec_id = c.vec_id AND e.y = p.y AND e.x = CASE WHEN p.x = c.r-1 THEN c.r-2 ELSE p.x+1 END
 GROUP BY c.vec_id""",
    crops="""
 SELECT vec_id, greatest(0, vec_id%3 - 1) AS l, vec_id%4 AS t,
   least(8, 5 + vec_id%5) AS r, least(8, 6 + vec_id%3) AS b FROM embeddings""",
    pixels=_PIXELS,
)


def _mean_model():
    def model(pixels):
        return [
            {"anchor_idx": int(pixels[0, 0, 0]), "cx": 0.0, "cy": 0.0, "w": 0.0, "h": 0.0,
             "obj": float(pixels.mean()) / 255.0, "cls0": 1.0}
        ]

    return model


def infer_detections(spark, sf):
    raw = models.infer_detections(v.gray_images(spark, sf), ["vec_id"], _mean_model)
    return raw.select("vec_id", "anchor_idx", *r6("obj"))


def _whole_face_model():
    def model(pixels):
        flat = pixels.astype("float32").reshape(-1)
        marks = [{"x": 2.0, "y": 2.0}, {"x": 6.0, "y": 2.0}, {"x": 4.0, "y": 5.0}]
        return [
            {"face_idx": 0, "x1": 0.0, "y1": 0.0, "x2": 8.0, "y2": 8.0, "detection_score": 0.9,
             "embedding": flat[:16].tolist(), "landmarks": marks}
        ]

    return model


def infer_faces(spark, sf):
    faces = models.infer_faces(v.gray_images(spark, sf), ["vec_id"], _whole_face_model, SEARCH)
    return faces.select(
        "vec_id",
        "face_idx",
        F.array_join("rejection_reasons", ",").alias("reasons"),
        *r6("roll_degrees", "yaw_proxy", "brightness"),
    )


_INFER_FACES_SQL = v.sql(
    """
 SELECT vec_id, 0::BIGINT AS face_idx, array_to_string(list_filter(['face_too_small',
   CASE WHEN blur < 45 THEN 'face_blurry' END,
   CASE WHEN light < 35 OR light > 225 THEN 'face_exposure_bad' END], lambda r: r IS NOT NULL), ',') AS reasons,
   0.0::DOUBLE AS roll_degrees, 0.0::DOUBLE AS yaw_proxy, round(light, 6) AS brightness
 FROM whole""",
    pixels=_PIXELS,
    whole="""
 SELECT p.vec_id, var_pop(n.g + s.g + w.g + e.g - 4.0*p.g) AS blur, avg(p.g) AS light,
   sum(CASE WHEN p.y < 2 THEN p.g*p.g ELSE 0 END) AS energy
 FROM pixels p
 JOIN pixels n ON n.vec_id = p.vec_id AND n.x = p.x AND n.y = CASE WHEN p.y = 0 THEN 1 ELSE p.y-1 END
 JOIN pixels s ON s.vec_id = p.vec_id AND s.x = p.x AND s.y = CASE WHEN p.y = 7 THEN 6 ELSE p.y+1 END
 JOIN pixels w ON w.vec_id = p.vec_id AND w.y = p.y AND w.x = CASE WHEN p.x = 0 THEN 1 ELSE p.x-1 END
 JOIN pixels e ON e.vec_id = p.vec_id AND e.y = p.y AND e.x = CASE WHEN p.x = 7 THEN 6 ELSE p.x+1 END
 GROUP BY p.vec_id HAVING energy > 0""",
)



def _png(levels: bytes) -> bytes:
    """An 8 x 8 gray picture as PNG."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        check = struct.pack(">I", zlib.crc32(kind + body))
        return struct.pack(">I", len(body)) + kind + body + check

    rows = b"".join(b"\0" + levels[k : k + 8] for k in range(0, 64, 8))
    head = struct.pack(">IIBBBBB", 8, 8, 8, 0, 0, 0, 0)
    start = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head)
    return start + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def _stored_pictures(spark, sf):
    """Each vector as a PNG file; every eleventh one is cut short."""

    def encode(batches):
        for batch in batches:
            ids = batch.column("vec_id")
            files = [
                _png(data)[: 30 if i % 11 == 3 else None]
                for i, data in zip(ids.to_pylist(), batch.column("data").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([ids, pa.array(files, pa.binary())], ["vec_id", "data"])

    path = fresh_path(spark, "photos")
    # A file of vectors may be one block, which one task reads.
    tasks = 4 * spark.sparkContext.defaultParallelism
    pixels = v.gray_images(spark, sf, tasks).select("vec_id", "image.data")
    files = pixels.mapInArrow(encode, "vec_id BIGINT, data BINARY")
    if sinks.local_path(path) is not None:
        name = F.expr("concat('part-', pmod(vec_id, 256), '/vec_id=', vec_id, '.png')")
        sinks.write_files(files.select(name.alias("path"), "data"), path)
    else:
        # A text file holds the bytes as they are; what ends the line is behind the end of the picture.
        files.select("vec_id", F.col("data").cast("string").alias("value")).write.partitionBy(
            "vec_id"
        ).text(path)
    photos = readers.read_photos(spark, f"{path}/*")
    return photos.withColumn(
        "photo_id", F.regexp_extract("path", r"vec_id=(\d+)", 1).cast("bigint")
    )


def photos(spark, sf):
    """Pictures written as files, read and decoded; some are broken."""
    return _stored_pictures(spark, sf).select("photo_id", "width", "height", "error_code")


# Limits for pictures of 8 x 8 pixels.
_TINY = QualityProfile(min_side=8, min_blur=5.0, min_detection=0.6, max_roll=25.0, max_yaw=0.45)


def enrolment_end_to_end(spark, sf):
    """Files to admitted uploads, faces, verdicts and stored targets; searches of three photos."""
    uploads = _stored_pictures(spark, sf).selectExpr(
        "photo_id DIV 3 AS search_id",
        "photo_id",
        "photo_id % 3 AS target_ord",
        "concat(' target ', photo_id) AS name",
        "CASE WHEN photo_id % 13 = 5 THEN 'image/gif' ELSE 'image/png' END AS content_type",
        "CASE WHEN photo_id % 17 = 2 THEN 20000000L ELSE 100L END AS length",
        "image",
    )
    store = fresh_path(spark, "gallery")
    verdicts = pipelines.enroll_pictures(
        uploads, _whole_face_model, "stub", store, fresh_path(spark, "staging"), _TINY
    )
    kinds = {"face_width": "INT", "face_height": "INT", "detection_score": "DOUBLE",
             "quality_score": "DOUBLE", "embedding": "ARRAY<FLOAT>", "name": "STRING", "model": "STRING"}
    schema = T.StructType.fromDDL(", ".join(f"{c} {kinds.get(c, 'BIGINT')}" for c in gallery.TARGET))
    stored = gallery.stored_targets(spark, store, schema).select(
        F.col("target_id").alias("photo_id"), F.size("embedding").cast("bigint").alias("dims")
    )
    return verdicts.join(stored, "photo_id", "left").select(
        "search_id", "photo_id", "name", "error_code", "error", *r6("quality_score"), "dims"
    )


_ENROLLED_SQL = v.sql(
    """
 SELECT search_id, photo_id, 'target ' || photo_id AS name, code AS error_code,
   CASE WHEN code = 'face_quality_low' THEN 'face quality is too low: ' || reasons END AS error,
   CASE WHEN code IS NULL THEN round(0.25*0.9 + 0.25*least(1.0, 8/12.0) + 0.27*least(1.0, blur/10.0)
     + 0.15*greatest(0.0, 1.0 - abs(light-130.0)/130.0) + 0.08, 6) END AS quality_score,
   CASE WHEN bool_and(code IS NULL) OVER (PARTITION BY search_id) THEN 16::BIGINT END AS dims
 FROM judged""",
    pixels=_PIXELS,
    whole="""
 SELECT p.vec_id, var_pop(n.g + s.g + w.g + e.g - 4.0*p.g) AS blur, avg(p.g) AS light,
   sum(CASE WHEN p.y < 2 THEN p.g*p.g ELSE 0 END) AS energy
 FROM pixels p
 JOIN pixels n ON n.vec_id = p.vec_id AND n.x = p.x AND n.y = CASE WHEN p.y = 0 THEN 1 ELSE p.y-1 END
 JOIN pixels s ON s.vec_id = p.vec_id AND s.x = p.x AND s.y = CASE WHEN p.y = 7 THEN 6 ELSE p.y+1 END
 JOIN pixels w ON w.vec_id = p.vec_id AND w.y = p.y AND w.x = CASE WHEN p.x = 0 THEN 1 ELSE p.x-1 END
 JOIN pixels e ON e.vec_id = p.vec_id AND e.y = p.y AND e.x = CASE WHEN p.x = 7 THEN 6 ELSE p.x+1 END
 GROUP BY p.vec_id""",
    judged="""
 SELECT *, CASE WHEN photo_id % 13 = 5 THEN 'unsupported_media_type' WHEN photo_id % 17 = 2 THEN 'image_too_large'
   WHEN photo_id % 11 = 3 THEN 'image_decode_failed' WHEN energy = 0 THEN 'no_face'
   WHEN reasons <> '' THEN 'face_quality_low' END AS code
 FROM (SELECT vec_id // 3 AS search_id, vec_id AS photo_id, blur, light, energy, array_to_string(list_filter([
   CASE WHEN blur < 5 THEN 'face_blurry' END,
   CASE WHEN light < 35 OR light > 225 THEN 'face_exposure_bad' END], lambda r: r IS NOT NULL), ', ') AS reasons
   FROM whole)""",
)


# --- boxes -------------------------------------------------------------------------------


def anchor_grid(spark, sf):
    used = derived.predictions(spark, sf).select("frame_id", "anchor_idx")
    return used.join(detect.anchor_grid(spark), "anchor_idx")


_GRID = """
 SELECT i AS anchor_idx, CASE WHEN i < 2704 THEN i%52 WHEN i < 3380 THEN (i-2704)%26 ELSE (i-3380)%13 END AS grid_x,
   CASE WHEN i < 2704 THEN i//52 WHEN i < 3380 THEN (i-2704)//26 ELSE (i-3380)//13 END AS grid_y,
   CASE WHEN i < 2704 THEN 8 WHEN i < 3380 THEN 16 ELSE 32 END::BIGINT AS stride FROM range(3549) t(i)"""


def decode_predictions(spark, sf):
    boxes = detect.decode_predictions(
        derived.predictions(spark, sf), v.pictures(spark, sf), ["frame_id"]
    )
    return boxes.select("frame_id", "anchor_idx", *r6("x1", "y1", "x2", "y2", "score"))


_DECODED = """
 SELECT p.frame_id, p.anchor_idx, ((p.cx+g.grid_x)*g.stride - exp(p.w)*g.stride/2.0)/s.ratio AS x1,
   ((p.cy+g.grid_y)*g.stride - exp(p.h)*g.stride/2.0)/s.ratio AS y1,
   ((p.cx+g.grid_x)*g.stride + exp(p.w)*g.stride/2.0)/s.ratio AS x2,
   ((p.cy+g.grid_y)*g.stride + exp(p.h)*g.stride/2.0)/s.ratio AS y2, p.obj*p.cls0 AS score
 FROM predictions p JOIN grid g USING (anchor_idx)
 JOIN (SELECT frame_id, least(416.0/height, 416.0/width)::DOUBLE AS ratio FROM pictures) s USING (frame_id)
 WHERE p.obj*p.cls0 >= 0.25"""


def prediction_count_errors(spark, sf):
    return detect.prediction_count_errors(derived.predictions(spark, sf), ["frame_id"])


def letterbox(spark, sf):
    return detect.add_letterbox(v.pictures(spark, sf)).select(
        "frame_id",
        *r6("ratio"),
        F.col("scaled_w").cast("bigint").alias("scaled_w"),
        F.col("scaled_h").cast("bigint").alias("scaled_h"),
    )


def nms(spark, sf):
    kept = detect.nms(derived.detections(spark, sf), ["source_id", "frame_id"])
    return kept.select("source_id", "frame_id", "det_idx", *r6("score"))


def _iou_sql(a, b):
    def area(x):
        return f"greatest(0,{x}.x2-{x}.x1)*greatest(0,{x}.y2-{x}.y1)"

    inter = (
        f"(greatest(0,least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))"
        f"*greatest(0,least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1)))"
    )
    return f"({inter}/greatest({area(a)}+{area(b)}-{inter},1e-6))"


_NMS_SQL = v.sql(
    """
 SELECT source_id, frame_id, det_idx, round(score, 6) AS score FROM flagged
 WHERE n = 1 OR (n = 2 AND k2) OR (n = 3 AND k3) OR (n = 4 AND NOT h14 AND NOT (k2 AND h24) AND NOT (k3 AND h34))""",
    ranked="""
 SELECT *, row_number() OVER (PARTITION BY source_id, frame_id ORDER BY score DESC, det_idx DESC) AS n
 FROM detections""",
    hides=f"""
 SELECT a.source_id, a.frame_id, bool_or(a.n=1 AND b.n=2 AND o) AS h12, bool_or(a.n=1 AND b.n=3 AND o) AS h13,
   bool_or(a.n=1 AND b.n=4 AND o) AS h14, bool_or(a.n=2 AND b.n=3 AND o) AS h23,
   bool_or(a.n=2 AND b.n=4 AND o) AS h24, bool_or(a.n=3 AND b.n=4 AND o) AS h34
 FROM (SELECT a, b, {_iou_sql("a", "b")} > 0.45 AS o FROM ranked a JOIN ranked b
       ON a.source_id = b.source_id AND a.frame_id = b.frame_id AND a.n < b.n)
 GROUP BY a.source_id, a.frame_id""",
    flagged="""
 SELECT r.*, h.*, NOT h12 AS k2, NOT h13 AND NOT (NOT h12 AND h23) AS k3
 FROM ranked r JOIN hides h USING (source_id, frame_id)""",
)


def iou_pairs(spark, sf):
    pairs = detect.iou_pairs(
        derived.tracks0(spark, sf),
        derived.detections(spark, sf),
        ["source_id", "frame_id"],
        0.3,
        "track_id",
        "det_idx",
    )
    return pairs.select("source_id", "frame_id", "track_id", "det_idx", *r6("iou"))


def normalize_boxes(spark, sf):
    sized = derived.tracks0(spark, sf).withColumns(
        {"width": F.lit(v.FRAME_W), "height": F.lit(v.FRAME_H)}
    )
    return detect.normalize_boxes(sized).select(
        "source_id", "frame_id", "track_id", *r8("x1", "y1", "x2", "y2")
    )


# --- matching and association ------------------------------------------------------------


def _gallery(spark, sf):
    return derived.targets(spark, sf).withColumn("active", F.expr("target_id % 5 <> 0"))


def match_gallery(spark, sf):
    found = matching.match_gallery(v.assessed(spark, sf), _gallery(spark, sf), 0.25)
    return found.select("source_id", "frame_id", "target_id", *r6("similarity"))


def match_gallery_join(spark, sf):
    """In blocks so small that the gallery has several at every scale."""
    found = matching.match_gallery(
        v.assessed(spark, sf), _gallery(spark, sf), 0.25, broadcast=False, block_bytes=64 * 1024
    )
    return found.select("source_id", "frame_id", "target_id", *r6("similarity"))


_MATCH_SQL = v.sql(
    """
 SELECT a.source_id, a.frame_id, m.target_id, round(m.similarity, 6) AS similarity
 FROM accepted a JOIN top1 m USING (vec_id) WHERE m.similarity >= 0.25 AND m.target_id % 5 <> 0"""
)


def match_target(spark, sf):
    """Every source is a search of its own, for the target with its number."""
    one = derived.targets(spark, sf).withColumn("search_id", F.col("target_id"))
    faces = v.assessed(spark, sf).withColumn("search_id", F.col("source_id"))
    seen = matching.match_target(faces, one)
    return seen.select("source_id", "frame_id", "target_id", *r6("similarity"), *r8("quality"))


def threshold_sweep(spark, sf):
    best = matching.best_target(v.assessed(spark, sf).where("accepted"), derived.targets(spark, sf))
    swept = matching.sweep(best, [0.20, 0.25, 0.30, 0.55])
    hits = swept.where("similarity >= threshold")
    return hits.groupBy("threshold", "target_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("similarity"), 5).alias("similarity")
    )


def associate_faces(spark, sf):
    placed = association.associate_faces(
        derived.faces(spark, sf, vectors=False), derived.tracks0(spark, sf)
    )
    return placed.select("source_id", "frame_id", "face_idx", "track_id")


_J3 = """
 SELECT f.*, t.track_id, row_number() OVER (PARTITION BY f.source_id, f.frame_id, f.face_idx
   ORDER BY (t.x2-t.x1)*(t.y2-t.y1), t.track_id) AS n
 FROM {faces} f JOIN tracks0 t ON f.source_id = t.source_id AND f.frame_id = t.frame_id
   AND (f.x1+f.x2)/2 BETWEEN t.x1 AND t.x2 AND (f.y1+f.y2)/2 BETWEEN t.y1 AND t.y1 + 0.6*(t.y2-t.y1)"""


def _two_faces(spark, sf):
    f = v.assessed(spark, sf, vectors=False).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.lit(1)))
    )
    return f.selectExpr(
        "source_id",
        "frame_id",
        "captured_ms",
        "CAST(j AS BIGINT) AS face_idx",
        "x1 + j*3 AS x1",
        "y1 + j*2 AS y1",
        "x2 + j*3 AS x2",
        "y2 + j*2 AS y2",
        "accepted AND NOT (j = 0 AND frame_id%5 = 2) AS accepted",
        "CASE WHEN frame_id%3 = j THEN quality + 0.1 WHEN frame_id%4 = 0 THEN 0.5 ELSE quality END AS quality",
    )


_TWO_FACES_SQL = """
 SELECT a.source_id, a.frame_id, a.captured_ms, i.j AS face_idx, x1 + i.j*3 AS x1, y1 + i.j*2 AS y1,
   x2 + i.j*3 AS x2, y2 + i.j*2 AS y2,
   CASE WHEN frame_id%3 = i.j THEN quality + 0.1 WHEN frame_id%4 = 0 THEN 0.5 ELSE quality END AS quality
 FROM accepted a CROSS JOIN idx i WHERE i.j < 2 AND NOT (i.j = 0 AND frame_id%5 = 2)"""


def best_face_per_track(spark, sf):
    placed = association.associate_faces(_two_faces(spark, sf), derived.tracks0(spark, sf))
    best = association.best_face_per_track(placed)
    return best.select("source_id", "frame_id", "track_id", "face_idx", *r8("quality"))


def tracks_as_of(spark, sf):
    ticks = v.frame_log(spark, sf).where("frame_id % 3 = 0")
    tracks = derived.tracks0(spark, sf).where("frame_id % 3 = 0")
    return association.tracks_as_of(v.frame_log(spark, sf), tracks, ticks).select(
        "source_id", "frame_id", "tick_frame", "track_id", *r6("x1", "y1")
    )


def _tracked(spark, sf, *params):
    """The frames are numbered once, for the ticks and for the boxes on them."""
    known = cut(derived.frames(spark, sf).select("source_id", "event_id", "frame_id", "captured_ms"))
    return tracking.track(known, derived.detections(spark, sf, known), *params)


def track(spark, sf):
    return _tracked(spark, sf).select(
        "source_id", "frame_id", "track_id", *r6("x1", "y1", "x2", "y2", "score"), "missed"
    )


def track_strong_only(spark, sf):
    """Tracks when nothing but new boxes can happen: overlap limits no pair can reach."""
    apart = TrackerParams(first_iou=2.0, second_iou=2.0, buffer=0)
    return _tracked(spark, sf, apart).select("source_id", "frame_id", "track_id", *r6("x1", "score"))


def box_motion(spark, sf):
    return tracking.box_motion(derived.tracks0(spark, sf)).select(
        "source_id", "track_id", "frame_id", *r6("dx1", "dy1", "dx2", "dy2")
    )


def _paired(left: str, right: str, min_iou: float) -> str:
    """DuckDB text for the greedy pairs [row, column] of two lists of boxes, by falling overlap in single
    precision; rows and columns are the fields r and c of the boxes."""
    shared = (
        "(greatest(least(t.x2, f.x2) - greatest(t.x1, f.x1), 0)"
        " * greatest(least(t.y2, f.y2) - greatest(t.y1, f.y1), 0))"
    )
    area = "(greatest({0}.x2 - {0}.x1, 0) * greatest({0}.y2 - {0}.y1, 0))"
    iou = (
        f"CAST({shared} / greatest({area.format('t')} + {area.format('f')} - {shared}, 1e-6) AS FLOAT)"
    )
    ranked = (
        f"list_sort(list_filter(flatten(list_transform({left}, lambda t: list_transform({right},"
        f" lambda f: struct_pack(o := -{iou}, r := t.r, c := f.c)))), lambda p:"
        f" p.o <= CAST(-{min_iou} AS FLOAT) AND p.o < 0))"
    )
    return (
        f"list_reduce(list_prepend(CAST([] AS BIGINT[][]), list_transform({ranked},"
        " lambda p: [[CAST(p.r AS BIGINT), CAST(p.c AS BIGINT)]])),"
        " lambda kept, p: CASE WHEN len(list_filter(kept, lambda k: k[1] = p[1][1] OR k[2] = p[1][2])) = 0"
        " THEN list_concat(kept, p) ELSE kept END)"
    )


_BOX = "x1 := {0}.x1 {1}, y1 := {0}.y1 {2}, x2 := {0}.x2 {3}, y2 := {0}.y2 {4}"
_MOVED = _BOX.format("t", "+ t.vx1", "+ t.vy1", "+ t.vx2", "+ t.vy2")
_HIT = (
    "struct_pack(id := t.id, x1 := f.x1, y1 := f.y1, x2 := f.x2, y2 := f.y2, vx1 := f.x1 - t.x1,"
    " vy1 := f.y1 - t.y1, vx2 := f.x2 - t.x2, vy2 := f.y2 - t.y2, score := f.score, missed := 0::BIGINT, r := t.r)"
)

# One step of the recursion is the n-th detector run of every source; the state is the list of live
# tracks, in the order of their ids.
TRACK_SQL = v.sql(
    f"""
 SELECT source_id, frame_id, t.id AS track_id, round(t.x1, 6) AS x1, round(t.y1, 6) AS y1,
   round(t.x2, 6) AS x2, round(t.y2, 6) AS y2, round(t.score, 6) AS score, CAST(t.missed AS INTEGER) AS missed
 FROM (SELECT source_id, frame_id, unnest(live) AS t FROM steps WHERE n > 0)""",
    runs="""
 SELECT f.source_id, f.frame_id, row_number() OVER (PARTITION BY f.source_id ORDER BY f.frame_id) AS n,
   coalesce(d.strong, []) AS strong, coalesce(d.weak, []) AS weak
 FROM frames f LEFT JOIN (
   SELECT source_id, frame_id,
     list(struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2, score := score, c := det_idx) ORDER BY det_idx)
       FILTER (score >= 0.5) AS strong,
     list(struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2, score := score, c := det_idx) ORDER BY det_idx)
       FILTER (score >= 0.1 AND score < 0.5) AS weak
   FROM detections GROUP BY source_id, frame_id) d USING (source_id, frame_id)""",
    steps=f"""
 SELECT DISTINCT source_id, CAST(-1 AS BIGINT) AS frame_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS born,
   CAST([] AS STRUCT(id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, vx1 DOUBLE, vy1 DOUBLE, vx2 DOUBLE,
                     vy2 DOUBLE, score DOUBLE, missed BIGINT, r BIGINT)[]) AS live
 FROM frames
 UNION ALL
 SELECT source_id, frame_id, n, born + len(fresh),
   list_concat(
     list_filter(list_transform(moved, lambda t: coalesce(
       list_transform(list_filter(strong, lambda f: list_contains(first, [t.r, f.c])), lambda f: {_HIT})[1],
       list_transform(list_filter(weak, lambda f: list_contains(second, [t.r, f.c])), lambda f: {_HIT})[1],
       t)), lambda t: t.missed <= 30),
     list_transform(fresh, lambda f, i: struct_pack(id := born + i, x1 := f.x1, y1 := f.y1, x2 := f.x2, y2 := f.y2,
       vx1 := 0::DOUBLE, vy1 := 0::DOUBLE, vx2 := 0::DOUBLE, vy2 := 0::DOUBLE, score := f.score,
       missed := 0::BIGINT, r := 0::BIGINT)))
 FROM (
  SELECT *, list_filter(strong, lambda f: NOT list_contains(list_transform(first, lambda p: p[2]), f.c)) AS fresh,
    {_paired("list_filter(moved, lambda t: NOT list_contains(list_transform(first, lambda p: p[1]), t.r))", "weak", 0.2)} AS second
  FROM (
   SELECT *, {_paired("moved", "strong", 0.3)} AS first
   FROM (
    SELECT r.source_id, r.frame_id, r.n, s.born, r.strong, r.weak,
      list_transform(s.live, lambda t, i: struct_pack(id := t.id, {_MOVED}, vx1 := t.vx1, vy1 := t.vy1, vx2 := t.vx2,
        vy2 := t.vy2, score := t.score, missed := t.missed + 1, r := CAST(i AS BIGINT))) AS moved
    FROM steps s JOIN runs r ON r.source_id = s.source_id AND r.n = s.n + 1)))""",
)


QUERIES = {
    "normalize_vectors": (
        normalize_vectors,
        v.sql(
            """
 SELECT vec_id, (p-1)::BIGINT AS pos, round((x::DOUBLE/len)::FLOAT::DOUBLE, 5) AS x FROM (
   SELECT vec_id, len, generate_subscripts(embedding, 1) AS p, unnest(embedding) AS x FROM (
     SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE))) AS len FROM scaled
     WHERE vec_id%17 <> 3 AND vec_id%11 <> 0 AND vec_id%13 <> 0))""",
            scaled=_SCALED_SQL,
        ),
    ),
    "invalid_vectors": (
        invalid_vectors,
        "SELECT vec_id FROM embeddings WHERE vec_id%17 = 3 OR vec_id%11 = 0 OR vec_id%13 = 0",
    ),
    "similarity": (
        similarity,
        "SELECT e.vec_id, round(list_inner_product(e.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity"
        " FROM embeddings e JOIN embeddings b ON e.vec_id = b.vec_id + 1",
    ),
    "pose_proxies": (
        pose,
        v.sql(
            "SELECT source_id, frame_id, round(roll_degrees, 6) AS roll_degrees,"
            " round(yaw_proxy, 6) AS yaw_proxy FROM pose_view",
            posed=_POSED_SQL,
            pose_view=_POSE_SQL,
        ),
    ),
    "quality_search": (lambda s, d: _quality(s, d, SEARCH), _quality_sql(SEARCH)),
    "quality_enrolment": (lambda s, d: _quality(s, d, ENROLMENT), _quality_sql(ENROLMENT)),
    "rejection_counts": (
        rejection_counts,
        v.sql(
            """
 SELECT reason, count(*) AS n FROM (
   SELECT 'face_too_small' AS reason FROM faces WHERE least(x2-x1, y2-y1) < 80
   UNION ALL SELECT 'detection_score_low' FROM faces WHERE detection_score < 0.45
   UNION ALL SELECT 'face_blurry' FROM faces WHERE blur_variance < 20
   UNION ALL SELECT 'face_exposure_bad' FROM faces WHERE brightness < 35 OR brightness > 225)
 GROUP BY reason"""
        ),
    ),
    "face_diagnostics": (
        face_diagnostics,
        v.sql(
            """
 SELECT f.source_id, count(*) AS face_observations, count(a.frame_id) AS accepted_faces
 FROM faces f LEFT JOIN accepted a USING (source_id, frame_id) GROUP BY f.source_id"""
        ),
    ),
    "crop_metrics": (crop_metrics, _CROP_SQL),
    "infer_detections": (
        infer_detections,
        v.sql(
            """
 SELECT vec_id, any_value(g) FILTER (WHERE x = 0 AND y = 0) AS anchor_idx, round(avg(g)/255.0, 6) AS obj
 FROM pixels GROUP BY vec_id""",
            pixels=_PIXELS,
        ),
    ),
    "infer_faces": (infer_faces, _INFER_FACES_SQL),
    "photos": (
        photos,
        """
 SELECT vec_id AS photo_id, CASE WHEN vec_id % 11 <> 3 THEN 8 END AS width, CASE WHEN vec_id % 11 <> 3 THEN 8 END AS height,
   CASE WHEN vec_id % 11 = 3 THEN 'image_decode_failed' END AS error_code FROM embeddings""",
    ),
    "enrolment_end_to_end": (enrolment_end_to_end, _ENROLLED_SQL),
    "anchor_grid": (
        anchor_grid,
        v.sql(
            "SELECT p.frame_id, g.* FROM predictions p JOIN grid g USING (anchor_idx)", grid=_GRID
        ),
    ),
    "decode_predictions": (
        decode_predictions,
        v.sql(
            "SELECT frame_id, anchor_idx, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2,"
            " round(y2, 6) AS y2, round(score, 6) AS score FROM decoded",
            grid=_GRID,
            decoded=_DECODED,
        ),
    ),
    "prediction_count_errors": (
        prediction_count_errors,
        v.sql(
            "SELECT frame_id, count(*) AS n_predictions FROM predictions GROUP BY frame_id"
            " HAVING count(*) <> 3549"
        ),
    ),
    "letterbox": (
        letterbox,
        v.sql(
            """
 SELECT frame_id, round(r, 6) AS ratio, trunc(width*r)::BIGINT AS scaled_w, trunc(height*r)::BIGINT AS scaled_h
 FROM (SELECT *, least(416.0::DOUBLE/height, 416.0::DOUBLE/width) AS r FROM pictures)"""
        ),
    ),
    "nms": (nms, _NMS_SQL),
    "iou_pairs": (
        iou_pairs,
        v.sql(
            f"""
 SELECT source_id, frame_id, source_id*10 + a.det_idx AS track_id, b.det_idx AS det_idx, round(iou, 6) AS iou
 FROM (SELECT source_id, frame_id, a, b, {_iou_sql("a", "b")} AS iou FROM (
   SELECT source_id, frame_id, unnest(tracked) AS a, found FROM listed) AS t, unnest(t.found) AS u(b)) WHERE iou >= 0.3""",
            # The boxes of a frame as one row, and the tracks that the view tracks0 makes of them.
            listed="""
 SELECT source_id, frame_id,
   list(struct_pack(det_idx := det_idx, x1 := x1, y1 := y1, x2 := x2, y2 := y2)) AS found,
   list(struct_pack(det_idx := det_idx, x1 := x1, y1 := y1, x2 := x2 + 60.0 - det_idx*30.0, y2 := y2 + 40.0))
     FILTER (det_idx IN (0, 2)) AS tracked
 FROM detections GROUP BY source_id, frame_id""",
        ),
    ),
    "normalize_boxes": (
        normalize_boxes,
        v.sql(
            "SELECT source_id, frame_id, track_id, "
            + ", ".join(
                f"round(least(1.0, greatest(0.0, {s}/{d}.0)), 8) AS {s}"
                for s, d in (("x1", 640), ("y1", 300), ("x2", 640), ("y2", 300))
            )
            + " FROM tracks0"
        ),
    ),
    "match_gallery": (match_gallery, _MATCH_SQL),
    "match_gallery_join": (match_gallery_join, _MATCH_SQL),
    "match_target": (
        match_target,
        v.sql(
            """
 SELECT a.source_id, a.frame_id, d.target_id, round(d.similarity, 6) AS similarity, round(a.quality, 8) AS quality
 FROM accepted a JOIN dots d ON d.vec_id = a.vec_id AND d.target_id = a.source_id"""
        ),
    ),
    "threshold_sweep": (
        threshold_sweep,
        v.sql(
            """
 SELECT threshold, target_id, count(*) AS n, round(sum(similarity), 5) AS similarity
 FROM seen CROSS JOIN (SELECT unnest([0.20, 0.25, 0.30, 0.55])::DOUBLE AS threshold)
 WHERE similarity >= threshold GROUP BY threshold, target_id"""
        ),
    ),
    "associate_faces": (
        associate_faces,
        v.sql(
            "SELECT source_id, frame_id, face_idx, track_id FROM placed WHERE n = 1",
            placed=_J3.format(faces="faces"),
        ),
    ),
    "best_face_per_track": (
        best_face_per_track,
        v.sql(
            """
 SELECT source_id, frame_id, track_id, face_idx, round(quality, 8) AS quality FROM (
   SELECT *, row_number() OVER (PARTITION BY source_id, frame_id, track_id ORDER BY quality DESC, face_idx) AS m
   FROM placed WHERE n = 1) WHERE m = 1""",
            two_faces=_TWO_FACES_SQL,
            placed=_J3.format(faces="two_faces"),
        ),
    ),
    "tracks_as_of": (
        tracks_as_of,
        v.sql(
            """
 SELECT f.source_id, f.frame_id, t.frame_id AS tick_frame, t.track_id, round(t.x1, 6) AS x1, round(t.y1, 6) AS y1
 FROM (SELECT f.source_id, f.frame_id, k.frame_id AS tick FROM frames f ASOF JOIN
        (SELECT source_id, frame_id FROM frames WHERE frame_id % 3 = 0) k
        ON f.source_id = k.source_id AND f.frame_id >= k.frame_id) f
 JOIN tracks0 t ON t.source_id = f.source_id AND t.frame_id = f.tick"""
        ),
    ),
    "track": (track, TRACK_SQL),
    "track_strong_only": (
        track_strong_only,
        v.sql(
            """
 SELECT source_id, frame_id, row_number() OVER (PARTITION BY source_id ORDER BY frame_id, det_idx) AS track_id,
   round(x1, 6) AS x1, round(score, 6) AS score FROM detections WHERE score >= 0.5"""
        ),
    ),
    "box_motion": (
        box_motion,
        v.sql(
            "SELECT source_id, track_id, frame_id, "
            + ", ".join(
                f"round({s} - lag({s}) OVER w, 6) AS d{s}" for s in ("x1", "y1", "x2", "y2")
            )
            + " FROM tracks0 WINDOW w AS (PARTITION BY source_id, track_id ORDER BY frame_id)"
        ),
    ),
}
