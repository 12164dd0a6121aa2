from __future__ import annotations

import pytest

from sightmatch.operators import evaluation

CONFIRMED = "case_id STRING, threshold DOUBLE, captured_ms BIGINT"
INTERVALS = "case_id STRING, idx BIGINT, start_ms BIGINT, end_ms BIGINT"
CASES = "case_id STRING, duration_ms BIGINT"


def metrics(spark, times, intervals, duration):
    return evaluation.case_metrics(
        spark.createDataFrame([("a", 0.5, t) for t in times], CONFIRMED),
        spark.createDataFrame([("a", i, s, e) for i, (s, e) in enumerate(intervals)], INTERVALS),
        spark.createDataFrame([("a", duration)], CASES),
        [0.5],
    ).first()


def test_recall_false_confirmations_and_delays(spark):
    row = metrics(spark, [12_000, 42_000, 80_000], [(10_000, 20_000), (40_000, 50_000)], 100_000)
    assert row.interval_recall == 1.0
    assert row.false_confirmations == 1
    assert row.negative_exposure_ms == 80_000
    assert row.false_confirmations_per_hour == pytest.approx(45.0)
    assert row.latencies_ms == [2000, 2000]


def test_boundary_belongs_to_the_later_interval(spark):
    row = metrics(spark, [20_000], [(10_000, 20_000), (20_000, 30_000)], 40_000)
    assert (row.detected_intervals, row.latencies_ms, row.false_confirmations) == (1, [0], 0)


def test_nothing_expected_and_no_negative_time(spark):
    row = metrics(spark, [], [], 10_000)
    assert row.interval_recall is None and row.false_confirmations_per_hour == 0.0
    row = metrics(spark, [5], [(0, 10_000)], 10_000)
    assert row.false_confirmations_per_hour is None and row.interval_recall == 1.0


def test_intervals_across_many_minutes(spark):
    times = [0, 59_999, 60_000, 3_599_999, 3_600_000]
    row = metrics(spark, times, [(59_999, 3_600_000)], 4_000_000)
    assert (row.false_confirmations, row.latencies_ms) == (2, [0])


def per_case(spark, *rows):
    return spark.createDataFrame(
        rows,
        "threshold DOUBLE, expected_intervals BIGINT, detected_intervals BIGINT,"
        " false_confirmations BIGINT, negative_exposure_ms BIGINT, latency_sum_ms BIGINT",
    )


def test_recommends_the_only_threshold_that_passes(spark):
    cases = per_case(spark, (0.55, 10, 10, 2, 36_000_000, 5000), (0.6, 10, 9, 1, 36_000_000, 7200))
    rated = evaluation.threshold_metrics(cases)
    assert {r.threshold: r.passed for r in rated.collect()} == {0.55: False, 0.6: True}
    best = evaluation.recommend_threshold(rated).first()
    assert (best.recommended_threshold, best.status) == (0.6, "passed")


def test_too_little_exposure_recommends_nothing(spark):
    rated = evaluation.threshold_metrics(per_case(spark, (0.55, 1, 1, 0, 35_999_000, 500)))
    assert not rated.first().negative_exposure_sufficient
    best = evaluation.recommend_threshold(rated).first()
    assert (best.recommended_threshold, best.status) == (None, "failed_or_insufficient_data")


def test_order_of_recommendation(spark):
    rows = [(0.5, 10, 10, 1, 36_000_000, 500), (0.6, 10, 10, 1, 36_000_000, 400), (0.7, 10, 10, 1, 36_000_000, 400)]
    rated = evaluation.threshold_metrics(per_case(spark, *rows))
    assert evaluation.recommend_threshold(rated).first()[0] == 0.7


def test_nearest_threshold_takes_the_first_of_a_tie(spark):
    listed = spark.createDataFrame([(0.5, 1), (0.6, 0)], "threshold DOUBLE, ord INT")
    assert evaluation.nearest_threshold(listed, 0.55).first()[0] in (0.5, 0.6)
    exact = spark.createDataFrame([(0.25, 1), (0.75, 0)], "threshold DOUBLE, ord INT")
    assert evaluation.nearest_threshold(exact, 0.5).first()[0] == 0.75


def test_bad_intervals(spark):
    good = spark.createDataFrame([("a", 0, 1000, 3000), ("a", 1, 5000, 8000)], INTERVALS)
    assert evaluation.validate_intervals(good).isEmpty()
    bad = spark.createDataFrame([("a", 0, 1000, 3000), ("a", 1, 2000, 4000), ("b", 0, -1, 4), ("b", 1, 7, 7)], INTERVALS)
    got = {(r.case_id, r.idx): r.error_code for r in evaluation.validate_intervals(bad).collect()}
    assert got == {("a", 1): "intervals_not_sorted", ("b", 0): "interval_invalid", ("b", 1): "interval_invalid"}


def test_half_rates_round_to_even(spark):
    frames = spark.range(12).selectExpr("1L AS source_id", "id AS frame_id")
    assert evaluation.decimate(frames, 12.5, 5.0).count() == 6
    assert evaluation.decimate(frames, 17.5, 5.0).count() == 3
    assert evaluation.decimate(frames, 1.0, 5.0).count() == 12
