"""Queries over labelled recordings and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import history
from catalog import views as v
from catalog.vision import r6
from sightmatch.operators import evaluation, matching
from sightmatch.params import EvalCriteria
from sightmatch.plans import pipelines
from sightmatch.sources import derived
from sightmatch.sources.scratch import cut

THRESHOLDS = history.THRESHOLDS
# Criteria that the derived views can meet; the defaults ask for more exposure than they hold.
REACHABLE = EvalCriteria(min_recall=0.8, max_false_per_hour=5000.0, min_exposure_hours=0.05)


def frame_log(spark, sf):
    return v.frame_log(spark, sf)


def decimate(spark, sf):
    at_15 = evaluation.decimate(v.frame_log(spark, sf), 15.0, 5.0)
    at_12 = evaluation.decimate(v.frame_log(spark, sf), 12.5, 5.0)
    both = at_15.withColumn("step", F.lit(3)).unionByName(at_12.withColumn("step", F.lit(2)))
    return both.select("source_id", "frame_id", F.col("step").cast("bigint").alias("step"))


def video_time(spark, sf):
    timed = evaluation.add_video_time(v.frame_log(spark, sf), 15.0)
    return timed.select("source_id", "frame_id", *r6("timestamp_s"))


def video_durations(spark, sf):
    return evaluation.video_durations(v.frame_log(spark, sf), 15.0).select(
        "source_id", "frames", *r6("duration_s")
    )


def confirmed(spark, sf):
    """confirmed0 under several thresholds, of which a higher one keeps fewer."""
    swept = matching.sweep(derived.confirmed0(spark, sf), THRESHOLDS)
    return swept.where("k >= 100*threshold - 20").select("case_id", "threshold", "captured_ms")


_CONFIRMED = """
 SELECT case_id, threshold, captured_ms FROM confirmed0 CROSS JOIN thresholds WHERE k >= 100*threshold - 20"""
_THRESHOLDS = "SELECT unnest([0.20, 0.25, 0.30, 0.55])::DOUBLE AS threshold, unnest([0, 1, 2, 3]) AS ord"


def events_in_intervals(spark, sf):
    inside = evaluation.events_in_intervals(confirmed(spark, sf), derived.intervals(spark, sf))
    return inside.select("case_id", "threshold", "idx", "first_ms", "n_inside", "latency_ms")


_INSIDE = """
 SELECT c.case_id, c.threshold, i.idx, min(c.captured_ms) AS first_ms, count(*) AS n_inside,
   min(c.captured_ms) - any_value(i.start_ms) AS latency_ms
 FROM confirmed c JOIN intervals i ON i.case_id = c.case_id AND c.captured_ms >= i.start_ms AND c.captured_ms < i.end_ms
 GROUP BY c.case_id, c.threshold, i.idx"""


def false_confirmations(spark, sf):
    return evaluation.false_confirmations(
        derived.confirmed0(spark, sf), derived.intervals(spark, sf)
    ).select("case_id", "captured_ms", "k")


def confirmed_counts(spark, sf):
    events = confirmed(spark, sf).withColumn("state", F.lit("confirmed"))
    return evaluation.confirmed_counts(events)


def _case_metrics(spark, sf):
    return evaluation.case_metrics(
        confirmed(spark, sf), derived.intervals(spark, sf), derived.cases(spark, sf), THRESHOLDS
    )


def case_metrics(spark, sf):
    return _case_metrics(spark, sf).select(
        "case_id", "threshold", "expected_intervals", "detected_intervals",
        "false_confirmations", "negative_exposure_ms",
        *r6("interval_recall", "false_confirmations_per_hour"),
        F.array_join(F.transform("latencies_ms", lambda x: x.cast("string")), ",").alias("latencies"),
    )


_CASE_METRICS = """
 SELECT g.case_id, g.threshold, g.expected AS expected_intervals, coalesce(d.n, 0) AS detected_intervals,
   coalesce(a.n, 0) - coalesce(d.true_n, 0) AS false_confirmations, greatest(0, duration_ms - inside_ms) AS negative_exposure_ms,
   CASE WHEN g.expected > 0 THEN coalesce(d.n, 0)/g.expected END AS interval_recall,
   CASE WHEN duration_ms > inside_ms THEN (coalesce(a.n, 0) - coalesce(d.true_n, 0))/((duration_ms - inside_ms)/3600000.0) END
     AS false_confirmations_per_hour, coalesce(d.latencies, '') AS latencies, coalesce(d.latency_sum, 0) AS latency_sum
 FROM (SELECT c.case_id, c.duration_ms, t.threshold, count(i.idx) AS expected,
         coalesce(sum(i.end_ms - i.start_ms), 0)::BIGINT AS inside_ms
       FROM cases c CROSS JOIN thresholds t LEFT JOIN intervals i ON i.case_id = c.case_id GROUP BY ALL) g
 LEFT JOIN (SELECT case_id, threshold, count(*) AS n, sum(n_inside)::BIGINT AS true_n, sum(latency_ms)::BIGINT AS latency_sum,
     string_agg(latency_ms, ',' ORDER BY idx) AS latencies FROM inside GROUP BY ALL) d USING (case_id, threshold)
 LEFT JOIN (SELECT case_id, threshold, count(*) AS n FROM confirmed GROUP BY ALL) a USING (case_id, threshold)"""


def _metric_columns(metrics):
    return metrics.select(
        "threshold", "expected_intervals", "detected_intervals", "false_confirmations",
        "negative_exposure_sufficient", "passed",
        *r6(
            "interval_recall", "negative_exposure_hours", "false_confirmations_per_hour",
            "mean_confirmation_latency_s",
        ),
    )


def threshold_metrics(spark, sf):
    return _metric_columns(evaluation.threshold_metrics(_case_metrics(spark, sf), REACHABLE))


def threshold_metrics_default(spark, sf):
    return _metric_columns(evaluation.threshold_metrics(_case_metrics(spark, sf)))


def _metrics_view(c):
    return f"""
 SELECT *, coalesce(interval_recall >= {c.min_recall} AND false_confirmations_per_hour <= {c.max_false_per_hour}
   AND negative_exposure_sufficient, false) AS passed FROM (
   SELECT threshold, sum(expected_intervals)::BIGINT AS expected_intervals, sum(detected_intervals)::BIGINT AS detected_intervals,
     sum(false_confirmations)::BIGINT AS false_confirmations,
     sum(negative_exposure_ms) >= {c.min_exposure_hours * 3600000} AS negative_exposure_sufficient,
     CASE WHEN sum(expected_intervals) > 0 THEN sum(detected_intervals)/sum(expected_intervals) END AS interval_recall,
     sum(negative_exposure_ms)/3600000.0 AS negative_exposure_hours,
     CASE WHEN sum(negative_exposure_ms) > 0 THEN sum(false_confirmations)/(sum(negative_exposure_ms)/3600000.0) END
       AS false_confirmations_per_hour,
     CASE WHEN sum(detected_intervals) > 0 THEN sum(latency_sum)/sum(detected_intervals)/1000.0 END AS mean_confirmation_latency_s
   FROM case_metrics GROUP BY threshold)"""


_METRICS_SQL = """
 SELECT threshold, expected_intervals, detected_intervals, false_confirmations, negative_exposure_sufficient, passed,
   round(interval_recall, 6) AS interval_recall, round(negative_exposure_hours, 6) AS negative_exposure_hours,
   round(false_confirmations_per_hour, 6) AS false_confirmations_per_hour,
   round(mean_confirmation_latency_s, 6) AS mean_confirmation_latency_s FROM metrics"""

_CHAIN = {
    "thresholds": _THRESHOLDS,
    "confirmed": _CONFIRMED,
    "inside": _INSIDE,
    "case_metrics": _CASE_METRICS,
}


def recommend_threshold(spark, sf):
    metrics = evaluation.threshold_metrics(_case_metrics(spark, sf), REACHABLE)
    return evaluation.recommend_threshold(metrics)


def nearest_threshold(spark, sf):
    listed = (
        _case_metrics(spark, sf)
        .groupBy("threshold")
        .agg((F.min("threshold") * 1000).cast("int").alias("ord"))
    )
    return evaluation.nearest_threshold(listed, 0.275)


def validate_intervals(spark, sf):
    listed = derived.frames(spark, sf).selectExpr(
        "source_id AS case_id",
        "frame_id AS idx",
        "captured_ms - 40 AS start_ms",
        "CASE WHEN k%50 = 7 THEN NULL ELSE captured_ms - 45 + k*4 END AS end_ms",
    )
    return evaluation.validate_intervals(listed).select(
        "case_id", "idx", "start_ms", "end_ms", "error_code"
    )


def validate_manifest(spark, sf):
    cases = derived.table(spark, sf, "customer").selectExpr(
        "CASE WHEN c_custkey%50 = 0 THEN 2 ELSE 1 END AS version",
        "CASE WHEN c_custkey%11 = 0 THEN concat('-', c_custkey) WHEN c_custkey%13 = 0 THEN concat('case ', c_custkey)"
        " WHEN c_custkey%17 = 0 THEN concat('x.', c_custkey, chr(10))"
        " ELSE concat('case-', c_custkey div 3 * 3 + least(c_custkey%3, 1)) END AS case_id",
        "CASE WHEN c_custkey%7 = 0 THEN ' ' ELSE c_name END AS target_name",
        "CASE WHEN c_custkey%19 = 0 THEN NULL ELSE 'p.png' END AS photo",
        "CASE WHEN c_custkey%23 = 0 THEN '' ELSE 'v.mp4' END AS video",
        "c_custkey",
        "10.0D AS duration_s",
        "15.0D AS fps",
    )
    ends = cases.groupBy("case_id").agg(
        (F.max("c_custkey") % 4 * F.lit(0.05) + F.lit(9.95)).alias("last_end_s")
    )
    return evaluation.validate_manifest(cases, ends).select("c_custkey", "case_id", "error_code")


_MANIFEST_SQL = v.sql(
    """
 SELECT c_custkey, m.case_id, CASE WHEN version <> 1 THEN 'invalid_version'
   WHEN c_custkey%11 = 0 OR c_custkey%13 = 0 OR c_custkey%17 = 0 THEN 'invalid_case_id' WHEN n > 1 THEN 'duplicate_case_id'
   WHEN c_custkey%7 = 0 THEN 'missing_target_name' WHEN c_custkey%19 = 0 THEN 'missing_photo'
   WHEN c_custkey%23 = 0 THEN 'missing_video'
   WHEN (last%4)*0.05 + 9.95 > 10.0 + 1.0/15.0 THEN 'interval_after_end' END AS error_code
 FROM m JOIN (SELECT case_id, count(*) AS n, max(c_custkey) AS last FROM m GROUP BY case_id) USING (case_id)""",
    m="""
 SELECT *, CASE WHEN c_custkey%50 = 0 THEN 2 ELSE 1 END AS version,
   CASE WHEN c_custkey%11 = 0 THEN '-' || c_custkey WHEN c_custkey%13 = 0 THEN 'case ' || c_custkey
     WHEN c_custkey%17 = 0 THEN 'x.' || c_custkey || chr(10)
     ELSE 'case-' || (c_custkey//3*3 + least(c_custkey%3, 1)) END AS case_id FROM customer""",
)


def _evaluated(spark, sf):
    """Offline evaluation: every source is a case with one target, over the derived tracks."""
    # The frames are numbered once, for the faces, the tracks and the log.
    known = cut(
        derived.frames(spark, sf).select(
            "source_id", "event_id", "frame_id", "captured_ms", "value", "k"
        )
    )
    faces = v.assessed(spark, sf, known=known).withColumn("search_id", F.col("source_id"))
    gallery = derived.table(spark, sf, "embeddings").join(
        derived.cases(spark, sf).select(F.col("case_id").alias("vec_id")), "vec_id", "left_semi"
    )
    targets = gallery.selectExpr(
        "vec_id AS search_id", "vec_id AS target_id", "0L AS target_ord", "embedding"
    )
    cases = derived.cases(spark, sf)
    return pipelines.evaluate(
        faces, derived.tracks0(spark, sf, known), known, targets, cases,
        derived.intervals(spark, sf), THRESHOLDS, REACHABLE,
    )


def evaluate(spark, sf):
    return _metric_columns(_evaluated(spark, sf)[2])


QUERIES = {
    "frame_log": (
        frame_log,
        v.sql("SELECT source_id, frame_id, captured_ms FROM frames"),
    ),
    "decimate": (
        decimate,
        v.sql(
            """
 SELECT source_id, frame_id, s.step FROM frames JOIN (SELECT unnest([2, 3])::BIGINT AS step) s ON frame_id % s.step = 0"""
        ),
    ),
    "video_time": (
        video_time,
        v.sql("SELECT source_id, frame_id, round(frame_id/15.0::DOUBLE, 6) AS timestamp_s FROM frames"),
    ),
    "video_durations": (
        video_durations,
        v.sql(
            "SELECT source_id, count(*) AS frames, round(count(*)/15.0::DOUBLE, 6) AS duration_s"
            " FROM frames GROUP BY source_id"
        ),
    ),
    "events_in_intervals": (events_in_intervals, v.sql("SELECT * FROM inside", **_CHAIN)),
    "false_confirmations": (
        false_confirmations,
        v.sql(
            """
 SELECT case_id, captured_ms, k FROM confirmed0 c WHERE NOT EXISTS (
   SELECT 1 FROM intervals i WHERE i.case_id = c.case_id AND c.captured_ms >= i.start_ms AND c.captured_ms < i.end_ms)"""
        ),
    ),
    "confirmed_counts": (
        confirmed_counts,
        v.sql(
            "SELECT threshold, count(*) AS confirmed_events FROM confirmed GROUP BY threshold",
            **_CHAIN,
        ),
    ),
    "case_metrics": (
        case_metrics,
        v.sql(
            """
 SELECT case_id, threshold, expected_intervals, detected_intervals, false_confirmations, negative_exposure_ms,
   round(interval_recall, 6) AS interval_recall, round(false_confirmations_per_hour, 6) AS false_confirmations_per_hour,
   latencies FROM case_metrics""",
            **_CHAIN,
        ),
    ),
    "threshold_metrics": (
        threshold_metrics,
        v.sql(_METRICS_SQL, **_CHAIN, metrics=_metrics_view(REACHABLE)),
    ),
    "threshold_metrics_default": (
        threshold_metrics_default,
        v.sql(_METRICS_SQL, **_CHAIN, metrics=_metrics_view(EvalCriteria())),
    ),
    "recommend_threshold": (
        recommend_threshold,
        v.sql(
            """
 SELECT best AS recommended_threshold, CASE WHEN best IS NULL THEN 'failed_or_insufficient_data' ELSE 'passed' END AS status
 FROM (SELECT first(threshold ORDER BY interval_recall DESC, false_confirmations_per_hour, mean_confirmation_latency_s, threshold DESC)
   AS best FROM metrics WHERE passed)""",
            **_CHAIN,
            metrics=_metrics_view(REACHABLE),
        ),
    ),
    "nearest_threshold": (
        nearest_threshold,
        v.sql(
            """
 SELECT threshold AS nearest_threshold FROM thresholds ORDER BY abs(threshold - 0.275), ord LIMIT 1""",
            **_CHAIN,
        ),
    ),
    "validate_intervals": (
        validate_intervals,
        v.sql(
            """
 SELECT * FROM (
   SELECT case_id, idx, start_ms, end_ms, CASE WHEN end_ms IS NULL OR start_ms < 0 OR end_ms <= start_ms THEN 'interval_invalid'
     WHEN start_ms < lag(end_ms) OVER (PARTITION BY case_id ORDER BY idx) THEN 'intervals_not_sorted' END AS error_code
   FROM (SELECT source_id AS case_id, frame_id AS idx, captured_ms - 40 AS start_ms,
     CASE WHEN k%50 = 7 THEN NULL ELSE captured_ms - 45 + k*4 END AS end_ms FROM frames)) WHERE error_code IS NOT NULL"""
        ),
    ),
    "validate_manifest": (validate_manifest, _MANIFEST_SQL),
    "evaluate": (
        evaluate,
        v.sql(
            _METRICS_SQL,
            thresholds=_THRESHOLDS,
            placed="""
 SELECT a.*, a.source_id AS target_id, t.track_id, row_number() OVER (PARTITION BY a.source_id, a.frame_id, a.face_idx
   ORDER BY (t.x2-t.x1)*(t.y2-t.y1), t.track_id) AS n,
   list_inner_product(f.embedding::DOUBLE[], g.embedding::DOUBLE[]) AS similarity
 FROM accepted a JOIN embeddings f USING (vec_id) JOIN embeddings g ON g.vec_id = a.source_id
 JOIN tracks0 t ON a.source_id = t.source_id AND a.frame_id = t.frame_id
   AND (a.x1+a.x2)/2 BETWEEN t.x1 AND t.x2 AND (a.y1+a.y2)/2 BETWEEN t.y1 AND t.y1 + 0.6*(t.y2-t.y1)""",
            seen_case="""
 SELECT source_id, track_id, target_id, frame_id, captured_ms, similarity, quality FROM placed WHERE n = 1""",
            **history.state_views(THRESHOLDS, 3, "seen_case"),
            confirmed="SELECT source_id AS case_id, threshold, captured_ms FROM told WHERE state = 'confirmed'",
            inside=_INSIDE,
            case_metrics=_CASE_METRICS,
            metrics=_metrics_view(REACHABLE),
        ),
    ),
}
