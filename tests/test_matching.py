"""Both ways of matching give the same rows, whatever the number of blocks."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightmatch.operators import matching


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    vector = lambda: [rng.gauss(0, 1) for _ in range(8)]
    targets = [(s, t, t, vector()) for s in (1, 2) for t in range(40 if s == 1 else 1)]
    faces = []
    for i in range(60):
        row = (1 + i % 2, i % 3, i // 3, 0, {"n": i}, vector())
        # Repeated rows, and other faces under the same key.
        faces += [row] * (1 + i % 4)
        if i % 5 == 0:
            faces.append((*row[:4], {"n": -i}, row[5]))
            faces.append((*row[:5], vector()))
    faces += [(1, None, None, None, None, vector())] * 3
    faces += [(1, 1, 1, 1, None, None), (None, 1, 1, 1, None, vector())]
    kind = "embedding ARRAY<DOUBLE>"
    return (
        spark.createDataFrame(
            faces,
            f"search_id BIGINT, source_id BIGINT, frame_id BIGINT, face_idx BIGINT, extra MAP<STRING, INT>, {kind}",
        ),
        spark.createDataFrame(targets, f"search_id BIGINT, target_id BIGINT, target_ord BIGINT, {kind}"),
    )


def listed(df):
    keys = ("search_id", "source_id", "frame_id", "face_idx", "target_id", "target_ord")
    return sorted(
        (str([r[k] for k in keys]), str(r["extra"]), round(r["similarity"], 12)) for r in df.collect()
    )


@pytest.mark.parametrize("block_bytes", [64, 640, 1 << 20])
def test_blocks_equal_matrix(rows, block_bytes):
    faces, targets = rows
    matrix = listed(matching.best_target(faces, targets, broadcast=True))
    blocks = listed(matching.best_target(faces, targets, broadcast=False, block_bytes=block_bytes))
    assert blocks == matrix
    usable = faces.where("embedding IS NOT NULL AND search_id IS NOT NULL").count()
    assert len(matrix) == usable


def test_no_faces_and_no_targets(rows):
    faces, targets = rows
    for f, t in ((faces.limit(0), targets), (faces, targets.limit(0))):
        assert matching.best_target(f, t, broadcast=False, block_bytes=64).isEmpty()
        assert matching.best_target(f, t, broadcast=True).where(F.lit(True)).isEmpty()


@pytest.mark.parametrize("broadcast", [True, False])
def test_repeated_vectors_are_scored_once_in_bounded_tiles(rows, broadcast, monkeypatch):
    faces, targets = rows
    # Copies of targets, among which the lowest target_ord wins, and one that is no number.
    odd = targets.where("search_id = 2").withColumn("target_id", F.lit(99).cast("bigint")).withColumn(
        "target_ord", F.lit(7).cast("bigint")
    )
    nan = odd.withColumn("embedding", F.transform("embedding", lambda x: F.lit(float("nan"))))
    for more in (odd, nan):
        both = targets.unionByName(more)
        plain = listed(matching.best_target(faces, both, broadcast=True))
        with monkeypatch.context() as patch:
            for name, value in {"REPEAT_BYTES": 0, "SHARE_BYTES": 640, "LANES": 3}.items():
                patch.setattr(matching, name, value)
            found = matching.best_target(faces, both, broadcast=broadcast, block_bytes=64)
            assert str(listed(found)) == str(plain)


def test_best_of_tiles_equals_best_of_all(monkeypatch):
    rng = random.Random(3)
    draw = lambda n: np.array([[rng.choice((-1.0, 0.0, 0.5)) for _ in range(3)] for _ in range(n)])
    vectors, targets = draw(40), draw(50)
    for name in ("_ROWS", "_COLS", "_PAIRS"):
        monkeypatch.setattr(matching, name, 7)
    best = matching._Best(vectors)
    for first in (0, 20):
        best.meet(targets[first : first + (20 if first == 0 else 30)], first)
    scores = (vectors[:, None, :] * targets[None]).sum(axis=2)
    assert best.at.tolist() == scores.argmax(axis=1).tolist()
    assert best.top.tolist() == scores.max(axis=1).tolist()


def test_a_gallery_that_is_large_for_an_executor_is_not_sent_to_it(spark):
    """23 MB of matrix, held several times by each Python worker while it is taken in."""
    targets = spark.range(40_000).selectExpr(
        "1L AS search_id", "id AS target_id", "id AS target_ord",
        "transform(sequence(1, 64), i -> CAST(IF(i = id % 64 + 1, 1, 0) AS FLOAT)) AS embedding",
    )
    faces = targets.limit(0).selectExpr("search_id", "0L AS source_id", "embedding")
    sent = len(matching._SHIPPED)
    matching.best_target(faces, targets)
    assert len(matching._SHIPPED) == sent


def test_large_galleries_join_faces_without_their_vectors(spark, rows):
    """Only the hashes of a vector go through the join; vectors with a null inside find nothing."""
    faces, targets = rows
    hole = faces.where("search_id = 1").limit(1).withColumn(
        "embedding", F.transform("embedding", lambda x, i: F.when(i > 0, x))
    )
    best = matching.best_target(faces.unionByName(hole), targets, broadcast=False, block_bytes=64)
    assert listed(best) == listed(matching.best_target(faces, targets, broadcast=True))
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    joined = [line for line in plan.splitlines() if "Join Inner" in line and "_hash" in line]
    assert joined and all("embedding" not in line for line in joined)


def test_searches_of_one_target_are_joined_and_give_the_same_rows(spark):
    rng = np.random.default_rng(5)
    sizes = {s: 3 + s % 2 for s in range(40)}
    targets = [(s, 100 + s, s, rng.normal(size=n).tolist()) for s, n in sizes.items() if s % 5]
    # Vectors of another length, searches without a target, vectors that are none, repeated faces.
    faces = [
        (s, s, f, 0, rng.normal(size=n + (f == 3)).tolist() if f != 4 else None)
        for s, n in sizes.items() for f in (0, 1, 1, 3, 4)
    ]
    faces += [(1, 1, 9, 0, [float("nan")] * sizes[1])]
    t = spark.createDataFrame(
        targets, "search_id BIGINT, target_id BIGINT, target_ord BIGINT, embedding ARRAY<FLOAT>"
    )
    f = spark.createDataFrame(
        faces, "search_id BIGINT, source_id BIGINT, frame_id BIGINT, face_idx BIGINT, embedding ARRAY<FLOAT>"
    )
    before = len(matching._SHIPPED)
    joined = matching.match_target(f, t)
    # One join instead of a stretch of rows, and a call, per search.
    assert "Join" in joined._jdf.queryExecution().executedPlan().toString()
    assert len(matching._SHIPPED) == before
    got = sorted(map(str, joined.collect()))
    assert len(got) == 32 * 3 + 1
    for way in (True, False):
        assert sorted(map(str, matching.match_target(f, t, broadcast=way).collect())) == got
