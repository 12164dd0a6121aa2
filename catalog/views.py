"""The derived views as DuckDB text, and the further views the queries share on the Spark side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightmatch.operators import quality
from sightmatch.params import QualityProfile
from sightmatch.sources import derived

# Blur limit under which the derived faces split about in half.
VIEW_PROFILE = QualityProfile(min_side=80, min_blur=20.0, min_detection=0.45)

FRAME_W, FRAME_H = 640, 300

# Times are cut to whole milliseconds; DuckDB's epoch_ms rounds, so the views divide.
_VIEWS = {
    "frames": """
 SELECT user_id AS source_id, event_id,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame_id,
        (epoch_us(ts) // 1000 - 1704067200000) // 100000 AS captured_ms, event_type, value,
        CAST(json_extract_string(props,'$.k') AS BIGINT) AS k
 FROM events""",
    "idx": "SELECT unnest([0, 1, 2, 3])::BIGINT AS j",
    "detections": """
 SELECT f.source_id, f.frame_id, f.captured_ms, d.j AS det_idx,
   CAST((f.source_id*17)%400 + f.frame_id*3 + d.j*9 AS DOUBLE) AS x1,
   CAST((f.source_id*29)%200 + d.j*5 AS DOUBLE) AS y1,
   CAST((f.source_id*17)%400 + f.frame_id*3 + d.j*9 + 60 + (f.event_id%5)*4 AS DOUBLE) AS x2,
   CAST((f.source_id*29)%200 + d.j*5 + 160 AS DOUBLE) AS y2,
   CAST((f.event_id*31 + d.j*17)%100 AS DOUBLE)/100.0 AS score
 FROM frames f CROSS JOIN idx d""",
    "faces": """
 SELECT f.source_id, f.frame_id, f.captured_ms, CAST(0 AS BIGINT) AS face_idx,
   (f.source_id + 20*(f.event_id%4)) % (SELECT count(*) FROM embeddings) AS vec_id,
   CAST((f.source_id*17)%400 + f.frame_id*3 + 20 AS DOUBLE) AS x1,
   CAST((f.source_id*29)%200 + 10 AS DOUBLE) AS y1,
   CAST((f.source_id*17)%400 + f.frame_id*3 + 20 + 60 + f.k AS DOUBLE) AS x2,
   CAST((f.source_id*29)%200 + 10 + 70 + f.k AS DOUBLE) AS y2,
   CAST(45 + (f.event_id*7)%55 AS DOUBLE)/100.0 AS detection_score,
   f.value AS blur_variance, CAST(f.k*256 AS DOUBLE)/100.0 AS brightness
 FROM frames f""",
    "targets": """
 SELECT vec_id AS target_id, vec_id AS target_ord,
   CASE WHEN vec_id % 2 = 1 THEN list_concat(embedding[2:], embedding[1:1]) ELSE embedding END AS embedding
 FROM embeddings""",
    "tracks0": """
 SELECT source_id, frame_id, captured_ms, source_id*10 + det_idx AS track_id,
   x1, y1, x2 + 60.0 - det_idx*30.0 AS x2, y2 + 40.0 AS y2, score
 FROM detections WHERE det_idx IN (0, 2)""",
    "predictions": """
 SELECT e.vec_id AS frame_id, (e.vec_id*7 + d.j*500) % 3549 AS anchor_idx,
   CAST(list_extract(e.embedding, CAST(d.j*16+1 AS INT)) AS DOUBLE) AS cx,
   CAST(list_extract(e.embedding, CAST(d.j*16+2 AS INT)) AS DOUBLE) AS cy,
   CAST(list_extract(e.embedding, CAST(d.j*16+3 AS INT)) AS DOUBLE) AS w,
   CAST(list_extract(e.embedding, CAST(d.j*16+4 AS INT)) AS DOUBLE) AS h,
   abs(CAST(list_extract(e.embedding, CAST(d.j*16+5 AS INT)) AS DOUBLE)) * 4.0 AS obj, 0.9 AS cls0
 FROM embeddings e CROSS JOIN idx d""",
    "pictures": """
 SELECT vec_id AS frame_id, CAST(640 + (vec_id%3)*320 AS INT) AS width,
   CAST(360 + (vec_id%2)*360 AS INT) AS height FROM embeddings""",
    "cases": """
 SELECT DISTINCT source_id AS case_id, CAST(25920 AS BIGINT) AS duration_ms FROM frames""",
    "intervals": """
 SELECT case_id, CAST(0 AS BIGINT) AS idx, 2000 + (case_id%7)*500 AS start_ms, 6000 + (case_id%7)*500 AS end_ms
 FROM cases WHERE case_id % 3 <> 0
 UNION ALL
 SELECT case_id, CAST(1 AS BIGINT), 12000 + (case_id%5)*700, 18000 + (case_id%5)*700 FROM cases WHERE case_id % 3 <> 0""",
    "confirmed0": """
 SELECT source_id AS case_id, captured_ms, k FROM frames WHERE event_type = 'purchase'""",
    "status_log": """
 SELECT source_id AS search_id, frame_id AS seq, captured_ms,
   CASE WHEN event_type = 'error' THEN 'source_lost' WHEN event_type = 'signup' THEN 'stopping'
        WHEN event_type = 'purchase' AND k < 5 THEN 'completed' ELSE 'running' END AS status,
   CASE WHEN event_type = 'error' THEN 'read failed' END AS error
 FROM frames""",
    # The gate of VIEW_PROFILE on the faces, without frame limits.
    "accepted": """
 SELECT *, 0.25*detection_score
   + 0.25*least(1.0, least(x2-x1, y2-y1)/120.0) + 0.27*least(1.0, blur_variance/40.0)
   + 0.15*greatest(0.0, 1.0-abs(brightness-130.0)/130.0) + 0.08 AS quality
 FROM faces WHERE least(x2-x1, y2-y1) >= 80 AND blur_variance >= 20 AND brightness BETWEEN 35 AND 225""",
    "dots": """
 SELECT v.vec_id, t.target_id, t.target_ord,
   list_inner_product(v.embedding::DOUBLE[], t.embedding::DOUBLE[]) AS similarity
 FROM embeddings v CROSS JOIN targets t""",
    "top1": """
 SELECT vec_id, target_id, similarity FROM (
   SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, target_ord) AS n FROM dots)
 WHERE n = 1""",
    # One track per source, visible on every frame; an accepted face per frame at most.
    "seen": """
 SELECT a.source_id, a.source_id AS track_id, m.target_id, a.frame_id, a.captured_ms, m.similarity, a.quality
 FROM accepted a JOIN top1 m USING (vec_id)""",
    "search_events": """
 SELECT source_id AS search_id, frame_id, captured_ms, k%5 AS target_id, k%3 AS track_id,
   CASE WHEN event_type = 'purchase' AND k%2 = 0 THEN 'confirmed'
        WHEN event_type = 'error' THEN 'lost' ELSE 'candidate' END AS state,
   value/100.0 AS similarity, CAST(k AS DOUBLE)/100.0 AS quality, k%4 AS evidence_count
 FROM frames""",
    "search_targets": """
 SELECT c.case_id AS search_id, i.j AS target_id, i.j AS target_ord,
   concat('target ', CAST(c.case_id*10 + i.j AS VARCHAR)) AS name FROM cases c CROSS JOIN idx i
 WHERE i.j < 3 OR c.case_id % 2 = 0""",
    "search_list": """
 SELECT case_id AS search_id, CAST(0 AS BIGINT) AS started_ms,
   CASE WHEN case_id % 4 <> 0 THEN 5000 + (case_id%9)*2500 END AS timeout_ms,
   CAST(25920 AS BIGINT) AS ended_ms FROM cases""",
    "numbered": """
 SELECT search_id, captured_ms AS occurred_at, state AS type, target_id, track_id, similarity, frame_id,
   CAST(row_number() OVER (PARTITION BY search_id ORDER BY captured_ms, frame_id) AS BIGINT) AS seq
 FROM search_events""",
}

SQL_PRELUDE = "WITH RECURSIVE " + ",\n".join(f"{n} AS ({t})" for n, t in _VIEWS.items())


def sql(body: str, **views: str) -> str:
    """A DuckDB query over the derived views and any further ones."""
    more = "".join(f",\n{name} AS ({text})" for name, text in views.items())
    return f"{SQL_PRELUDE}{more}\n{body}"


# --- the same further views for Spark ---------------------------------------------------


def frame_log(spark: SparkSession, sf: str) -> DataFrame:
    return derived.frames(spark, sf).select("source_id", "frame_id", "captured_ms")


def pictures(spark: SparkSession, sf: str) -> DataFrame:
    return derived.table(spark, sf, "embeddings").selectExpr(
        "vec_id AS frame_id",
        "CAST(640 + (vec_id%3)*320 AS INT) AS width",
        "CAST(360 + (vec_id%2)*360 AS INT) AS height",
    )


def assessed(
    spark: SparkSession, sf: str, *, vectors: bool = True, known: DataFrame | None = None
) -> DataFrame:
    faces = derived.faces(spark, sf, vectors=vectors, known=known)
    return quality.assess(faces, VIEW_PROFILE).withColumn(
        "search_id", F.lit(1).cast("bigint")
    )


def search_events(spark: SparkSession, sf: str) -> DataFrame:
    return derived.frames(spark, sf).selectExpr(
        "source_id AS search_id",
        "frame_id",
        "captured_ms",
        "k%5 AS target_id",
        "k%3 AS track_id",
        "CASE WHEN event_type = 'purchase' AND k%2 = 0 THEN 'confirmed'"
        " WHEN event_type = 'error' THEN 'lost' ELSE 'candidate' END AS state",
        "value/100.0D AS similarity",
        "CAST(k AS DOUBLE)/100.0D AS quality",
        "k%4 AS evidence_count",
    )


def search_targets(spark: SparkSession, sf: str) -> DataFrame:
    return (
        derived.cases(spark, sf)
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3))))
        .where("j < 3 OR case_id % 2 = 0")
        .selectExpr(
            "case_id AS search_id",
            "CAST(j AS BIGINT) AS target_id",
            "CAST(j AS BIGINT) AS target_ord",
            "concat('target ', CAST(case_id*10 + j AS STRING)) AS name",
        )
    )


def search_list(spark: SparkSession, sf: str) -> DataFrame:
    return derived.cases(spark, sf).selectExpr(
        "case_id AS search_id",
        "CAST(0 AS BIGINT) AS started_ms",
        "CASE WHEN case_id % 4 <> 0 THEN 5000 + (case_id%9)*2500 END AS timeout_ms",
        "CAST(25920 AS BIGINT) AS ended_ms",
    )


def gray_images(spark: SparkSession, sf: str, tasks: int | None = None) -> DataFrame:
    """Each vector as an 8 x 8 gray picture in the form of Spark's image source; `tasks`: spread over so many."""
    level = "lpad(hex(CAST(floor(abs(CAST(x AS DOUBLE))*1000) AS INT) % 256), 2, '0')"
    vectors = derived.table(spark, sf, "embeddings").select("vec_id", "embedding")
    if tasks:
        vectors = vectors.repartition(tasks, "vec_id")
    return vectors.select(
        "vec_id",
        F.struct(
            F.lit(8).alias("height"),
            F.lit(8).alias("width"),
            F.lit(1).alias("nChannels"),
            F.expr(f"unhex(array_join(transform(embedding, x -> {level}), ''))").alias("data"),
        ).alias("image"),
    )
