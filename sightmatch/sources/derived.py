"""Views that give every operator input, derived from the given tables (see FIXTURES.md, B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightmatch.functions import ordered

# Fixed value: the derived time axis starts here and runs 100,000 times faster.
EPOCH = "2024-01-01 00:00:00"
SPEEDUP = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    elapsed = F.expr(
        f"timestampdiff(MILLISECOND, timestamp_ntz'{EPOCH}', cast(ts AS timestamp_ntz))"
    )
    timed = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source_id"),
        "event_id",
        elapsed.alias("elapsed_ms"),
        F.expr("unix_micros(cast(cast(ts AS timestamp_ntz) AS timestamp))").alias("at_us"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    # A source with many frames is cut into slices of the microsecond clock: one day.  With few, a slice
    # holds two or three rows, and most of the work would be about slices.
    whole = ordered.fits_a_task(table(spark, sf_dir, "events"), ["user_id"])
    numbered = ordered.number_rows(
        timed, ["source_id"], ["at_us", "event_id"], "_n", size=86_400_000_000, single=whole
    )
    return numbered.select(
        "source_id",
        "event_id",
        (F.col("_n") - 1).alias("frame_id"),
        F.expr(f"elapsed_ms div {SPEEDUP}").alias("captured_ms"),
        "event_type",
        "value",
        "k",
    )


def detections(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """Four boxes a frame.  `known`: the frames, where they are at hand."""
    f = frames(spark, sf_dir) if known is None else known
    f = f.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return f.selectExpr(
        "source_id",
        "frame_id",
        "captured_ms",
        "CAST(j AS BIGINT) AS det_idx",
        "CAST((source_id*17)%400 + frame_id*3 + j*9 AS DOUBLE) AS x1",
        "CAST((source_id*29)%200 + j*5 AS DOUBLE) AS y1",
        "CAST((source_id*17)%400 + frame_id*3 + j*9 + 60 + (event_id%5)*4 AS DOUBLE) AS x2",
        "CAST((source_id*29)%200 + j*5 + 160 AS DOUBLE) AS y2",
        "CAST((event_id*31 + j*17)%100 AS DOUBLE)/100.0D AS score",
    )


def faces(
    spark: SparkSession, sf_dir: str, *, vectors: bool = True, known: DataFrame | None = None
) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings")
    size = vecs.agg(F.count(F.lit(1))).scalar()
    f = (frames(spark, sf_dir) if known is None else known).withColumn("n_vecs", size)
    out = f.selectExpr(
        "source_id",
        "frame_id",
        "captured_ms",
        "CAST(0 AS BIGINT) AS face_idx",
        "(source_id + 20*(event_id%4)) % n_vecs AS vec_id",
        "CAST((source_id*17)%400 + frame_id*3 + 20 AS DOUBLE) AS x1",
        "CAST((source_id*29)%200 + 10 AS DOUBLE) AS y1",
        "CAST((source_id*17)%400 + frame_id*3 + 20 + 60 + k AS DOUBLE) AS x2",
        "CAST((source_id*29)%200 + 10 + 70 + k AS DOUBLE) AS y2",
        "CAST(45 + (event_id*7)%55 AS DOUBLE)/100.0D AS detection_score",
        "value AS blur_variance",
        "CAST(k*256 AS DOUBLE)/100.0D AS brightness",
    )
    if not vectors:
        return out
    return out.join(vecs.select("vec_id", "embedding"), "vec_id")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gallery of search 1: all vectors.  Every second one has its first component moved to
    the end, so that the faces made from it have no equal target and meet the thresholds."""
    turned = "concat(slice(embedding, 2, size(embedding) - 1), slice(embedding, 1, 1))"
    return table(spark, sf_dir, "embeddings").select(
        F.lit(1).cast("bigint").alias("search_id"),
        F.col("vec_id").alias("target_id"),
        F.col("vec_id").alias("target_ord"),
        F.expr(f"IF(vec_id % 2 = 1, {turned}, embedding)").alias("embedding"),
    )


def tracks0(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    return detections(spark, sf_dir, known).where("det_idx IN (0, 2)").selectExpr(
        "source_id",
        "frame_id",
        "captured_ms",
        "source_id*10 + det_idx AS track_id",
        "x1",
        "y1",
        "x2 + 60.0D - det_idx*30.0D AS x2",
        "y2 + 40.0D AS y2",
        "score",
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.lit(3)))
    )
    raw = {name: f"CAST(element_at(embedding, j*16+{i}) AS DOUBLE)" for i, name in
           enumerate(("cx", "cy", "w", "h", "obj"), start=1)}
    return e.selectExpr(
        "vec_id AS frame_id",
        "(vec_id*7 + j*500) % 3549 AS anchor_idx",
        *[f"{raw[n]} AS {n}" for n in ("cx", "cy", "w", "h")],
        f"abs({raw['obj']}) * 4.0D AS obj",
        "0.9D AS cls0",
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("case_id"))
        .agg(F.lit(25920).cast("bigint").alias("duration_ms"))
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.expr(
        "array(named_struct('idx', 0L, 's', 2000 + (case_id%7)*500, 'e', 6000 + (case_id%7)*500),"
        " named_struct('idx', 1L, 's', 12000 + (case_id%5)*700, 'e', 18000 + (case_id%5)*700))"
    )
    return (
        cases(spark, sf_dir)
        .where("case_id % 3 <> 0")
        .select("case_id", F.explode(pair).alias("i"))
        .select(
            "case_id", "i.idx", F.col("i.s").alias("start_ms"), F.col("i.e").alias("end_ms")
        )
    )


def confirmed0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).where("event_type = 'purchase'").select(
        F.col("source_id").alias("case_id"), "captured_ms", "k"
    )


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).selectExpr(
        "source_id AS search_id",
        "frame_id AS seq",
        "captured_ms",
        "CASE WHEN event_type = 'error' THEN 'source_lost' WHEN event_type = 'signup' THEN 'stopping'"
        " WHEN event_type = 'purchase' AND k < 5 THEN 'completed' ELSE 'running' END AS status",
        "CASE WHEN event_type = 'error' THEN 'read failed' END AS error",
    )
