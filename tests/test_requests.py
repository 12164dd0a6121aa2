"""Which search answers a request, against a plain loop."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sightmatch.operators import admission, searches
from sightmatch.sources import readers, sinks
from sightmatch.streaming import queries as streams

KINDS = "request_id STRING, search_id BIGINT, ord BIGINT, at_ms BIGINT"


def plain(requests, ends):
    active, out = {}, []
    for name, search, ord_, at in sorted(requests, key=lambda r: (r[3], r[2])):
        if name:
            started, until = active.get(name, (None, at))
            if until is not None and at >= until:
                later = [e for s, e in ends if s == search and e > at]
                active[name] = started, _ = search, min(later, default=None)
        out.append((name, started if name else search, ord_, at))
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(3)
    # A third of all requests has one id; some searches end at once, some never, some are unknown.
    requests = [
        (rng.choice(("hot", "hot", "b", "c", "d", "", None)), 1000 + i, i, 1_000_000 + rng.randrange(80) * 1000)
        for i in range(400)
    ]
    ends = [
        (r[1], r[3] + rng.choice((500, 1000, 3000, 9000) if r[0] == "hot" else (-5000, 0, 1000, 9000)))
        for r in requests if r[0] == "hot" or rng.random() < 0.9
    ]
    return requests, ends + [(7, 5)] + ends[:20]


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.select("request_id", "search_id", "ord", "at_ms").collect())))


@pytest.mark.parametrize("batch", [3, 10_000])
def test_chain_over_parts_and_batches(spark, case, batch):
    requests, ends = case
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = searches.answer_requests(
            spark.createDataFrame(requests, KINDS).repartition(5),
            spark.createDataFrame(ends, "search_id BIGINT, ended_at BIGINT"),
            size=7000,
        )
        want = plain(requests, ends)
        assert rows(got) == sorted(map(str, want))
        assert 10 < len({w[1] for w in want if w[0] == "hot"}) < 100
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_requests_and_no_ends(spark, case):
    none = spark.createDataFrame([], "search_id BIGINT, ended_at BIGINT")
    asked = spark.createDataFrame(case[0], KINDS).withColumn("extra", F.lit("x"))
    got = searches.answer_requests(asked, none)
    assert got.columns == asked.columns
    # Nothing ends, so each id has one search.
    assert got.where("request_id <> ''").select("search_id").distinct().count() == 4
    assert searches.answer_requests(asked.limit(0), none).isEmpty()


def test_stream_equals_batch_and_forgets(spark, tmp_path, case):
    requests = [r for r in case[0] if r[0] != "d"]
    # The last search of every id ends as well.
    ends = [(r[1], r[3] + 5000) for r in requests]
    names = {r[1]: r[0] for r in requests}
    asked = spark.createDataFrame(requests, KINDS)
    ended = spark.createDataFrame([(names[s], s, e) for s, e in ends], "request_id STRING, search_id BIGINT, ended_at BIGINT")
    paths = []
    for df, time in ((asked, "at_ms"), (ended, "ended_at")):
        paths.append(str(tmp_path / time))
        df.repartition(3).write.parquet(paths[-1])
        last = {"request_id": "-", time: 90_000_000, "search_id": -1}
        row = spark.range(1).select(*[F.lit(last.get(c)).cast(k).alias(c) for c, k in df.dtypes])
        row.coalesce(1).write.mode("append").parquet(paths[-1])
    inputs = [readers.stream_frames(spark, p, df.schema, 1) for p, df in zip(paths, (asked, ended), strict=True)]
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")
    query = sinks.write_event_log(streams.answer_stream(*inputs, lateness="1 hour"), out, checkpoint)
    query.awaitTermination()
    assert streams.late_rows(query) == 0
    got = spark.read.parquet(out)
    assert rows(got) == rows(searches.answer_requests(asked, ended.drop("request_id")))
    # Each search has ended, so no id is remembered.
    state = spark.read.format("statestore").option("stateVarName", "active").load(checkpoint)
    assert state.count() == 0


def test_batches_are_parsed_and_joined_once(spark):
    """Requests were parsed and their files shuffled once per use: the work of the join three times."""
    spec = lambda *names: "[" + ", ".join(f'{{"name": "n{f}", "image_filename": "{f}"}}' for f in names) + "]"
    batches = spark.createDataFrame(
        [
            (1, spec("a", "b")), (2, spec("a", "b")), (3, spec("a", "b")), (4, spec(*"ab")[:-1]), (5, spec("a")),
            (6, spec(*range(21))), (7, "[]"), (8, spec("a", "a")), (9, '[{"name": 1, "image_filename": "a"}]'),
            (10, spec("a")), (None, spec("a")),
        ],
        "batch_id BIGINT, targets STRING",
    )
    files = [(1, "x/a"), (1, "b"), (2, "a"), (2, "c"), (3, "a"), (3, "a"), (4, "a"), (5, None), (8, "a"), (8, "a")]
    files += [(6, str(i)) for i in range(21)] + [(9, "a"), (11, "a"), (None, "a")]
    uploads = spark.createDataFrame(files, "batch_id BIGINT, filename STRING")
    checked, matched = admission.reconcile_batch(batches, uploads)
    assert {r.batch_id: (r.n_files, r.n_specs, r.error_code) for r in checked.collect()} == {
        1: (2, 2, None), 2: (2, 2, "image_target_mismatch"), 3: (2, 2, None), 4: (1, 0, "invalid_batch_request"),
        5: (1, 1, "image_target_mismatch"), 6: (21, 21, "too_many_targets"), 7: (0, 0, "invalid_targets"),
        8: (2, 2, "invalid_targets"), 9: (1, 1, "invalid_targets"), 10: (0, 1, "image_target_mismatch"),
        None: (0, 1, "image_target_mismatch"),
    }
    assert sorted(tuple(r) for r in matched.collect()) == [
        (1, "a", "na"), (1, "b", "nb"), (3, "a", "na"), (3, "a", "na"),
    ]
    for part in (checked, matched):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == 1 and plan.count("parse_json") <= 1
