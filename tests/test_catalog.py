"""Every query against its SQL twin at the smallest scale."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import SMALL, entry, oracle_sql, queries
from catalog import history, views
from catalog.check import compare, connect
from sightmatch.operators import evidence, matching
from sightmatch.sources import derived

# Events per threshold and state at the smallest scale, against the first twenty vectors.
GOLDEN = {
    (0.2, "candidate"): 272, (0.2, "confirmed"): 10, (0.2, "lost"): 9,
    (0.25, "candidate"): 163, (0.25, "confirmed"): 7, (0.25, "lost"): 6,
    (0.3, "candidate"): 115, (0.3, "confirmed"): 2, (0.3, "lost"): 2,
    (0.55, "candidate"): 101, (0.55, "confirmed"): 1, (0.55, "lost"): 1,
}


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def counts(rows):
    return {tuple(r[:2]): r[2] for r in rows}


def test_fixture_counts(spark):
    targets = derived.table(spark, SMALL, "embeddings").where("vec_id < 20").selectExpr(
        "1L AS search_id", "vec_id AS target_id", "vec_id AS target_ord", "embedding"
    )
    best = matching.best_target(views.assessed(spark, SMALL).where("accepted"), targets)
    swept = matching.sweep(best.withColumn("track_id", F.col("source_id")), history.THRESHOLDS)
    events = evidence.confirm(swept, views.frame_log(spark, SMALL))
    assert counts(events.groupBy("threshold", "state").count().collect()) == GOLDEN


def test_flagship(spark, duck):
    want = duck.execute(
        f"SELECT threshold, state, count(*) FROM ({oracle_sql()['confirm']}) GROUP BY ALL"
    ).fetchall()
    assert counts(entry(spark).select("threshold", "state", "n_events").collect()) == counts(want)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    verdict, n, _, _ = compare(spark, duck, SMALL, name)
    assert verdict in ("same", "rows only"), verdict
    assert n > 0 or name in oracle_sql()
