"""Queries that write and read back, or run as streams until their input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import admit, history, scoring, vision
from catalog import views as v
from catalog.vision import r6, r8
from sightmatch import schemas
from sightmatch.operators import evaluation, eventlog
from sightmatch.sources import derived, gallery, readers, sinks
from sightmatch.sources.scratch import fresh_path
from sightmatch.streaming import queries as streams


def manifest(spark, sf):
    """Manifests written as JSON lines and read again."""
    cases, intervals = derived.cases(spark, sf), derived.intervals(spark, sf)
    # At most two intervals per case.
    pairs = intervals.groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "start_ms", "end_ms"))).alias("i")
    )
    listed = F.transform(
        F.coalesce("i", F.expr("array()")),
        lambda p: F.array(p["start_ms"] / 1000.0, p["end_ms"] / 1000.0),
    )
    name = F.concat(F.lit("case-"), F.col("case_id").cast("string"))
    case = F.struct(
        name.alias("id"),
        F.when(F.col("case_id") % 2 == 0, F.lit("/media/p.png")).otherwise("p.png").alias("photo"),
        F.concat(F.lit("video/"), name, F.lit(".mp4")).alias("video"),
        F.concat(F.lit(" "), name, F.lit(" ")).alias("target_name"),
        listed.alias("expected_intervals_seconds"),
    )
    path = fresh_path(spark, "manifests")
    cases.join(pairs, "case_id", "left").select(
        F.lit(1).alias("version"), F.array(case).alias("cases")
    ).write.json(path)
    read_cases, read_intervals = readers.read_manifest(spark, f"{path}/*.json", lines=True)
    totals = read_intervals.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("start_ms").alias("starts"), F.sum("end_ms").alias("ends")
    )
    return read_cases.join(totals, "case_id", "left").select(
        "case_id",
        "target_name",
        F.col("photo").startswith("/media/").alias("absolute"),
        F.col("video").endswith("/video/" + "case-0.mp4").alias("first_case"),
        "n",
        "starts",
        "ends",
    )


def manifest_errors(spark, sf):
    """Manifests of which some are cut short, empty, of another version or with odd intervals."""
    text = F.expr(
        "CASE case_id % 7 WHEN 1 THEN concat('{\"version\": 1, \"cases\": [{\"id\": \"', case_id)"
        " WHEN 2 THEN '{\"version\": 1, \"cases\": []}'"
        " ELSE concat('{\"version\": ', IF(case_id % 7 = 3, 2, 1), ', \"cases\": [{\"id\": \"c', case_id,"
        " '\", \"photo\": \"p\", \"video\": \"v\", \"target_name\": \"n\", \"expected_intervals_seconds\": [[1, 2',"
        " IF(case_id % 7 = 4, ', 3', ''), ']]}]}') END"
    )
    path = fresh_path(spark, "bad-manifests")
    derived.cases(spark, sf).select(text.alias("value")).write.text(path)
    errors = readers.manifest_errors(spark, f"{path}/*.txt", lines=True)
    return errors.groupBy("error_code", "case_id").agg(F.count(F.lit(1)).alias("n"))


def case_reports(spark, sf):
    """Reports per case, written and read again."""
    path = fresh_path(spark, "reports")
    metrics = scoring._case_metrics(spark, sf)
    sinks.write_case_reports(metrics, scoring.confirmed(spark, sf), path)
    reports = spark.read.schema(
        "schema_version INT, case_id BIGINT, threshold_results ARRAY<STRUCT<threshold: DOUBLE,"
        " expected_intervals: BIGINT, detected_intervals: BIGINT, interval_recall: DOUBLE,"
        " false_confirmations: BIGINT>>"
    ).json(f"{path}/reports")
    events = spark.read.schema("case_id BIGINT, threshold DOUBLE, captured_ms BIGINT").json(
        f"{path}/events"
    )
    written = events.groupBy("case_id", "threshold").agg(F.count(F.lit(1)).alias("n_events"))
    rows = reports.select("case_id", F.inline("threshold_results"))
    return rows.join(written, ["case_id", "threshold"], "left").select(
        "case_id", "threshold", "expected_intervals", "detected_intervals", "false_confirmations",
        F.coalesce("n_events", F.lit(0)).alias("n_events"), *r6("interval_recall"),
    )


def summary_report(spark, sf):
    path = fresh_path(spark, "summary")
    metrics = evaluation.threshold_metrics(scoring._case_metrics(spark, sf), scoring.REACHABLE)
    sinks.write_summary_report(
        metrics, evaluation.recommend_threshold(metrics), path, scoring.REACHABLE
    )
    report = spark.read.json(f"{path}/summary")
    return report.select(
        F.col("schema_version").cast("bigint").alias("schema_version"),
        "recommended_similarity_threshold",
        "status",
        F.col("acceptance_criteria.minimum_interval_recall").alias("minimum_interval_recall"),
        F.inline("aggregate"),
    ).select(
        "schema_version", "recommended_similarity_threshold", "status", "minimum_interval_recall",
        "threshold", "passed", "detected_intervals",
    )


def checksum_audit(spark, sf):
    """The tables' own files against expected sums, of which some are wrong or unknown."""
    files = readers.read_files(spark, sf, "*.parquet")
    known = files.select(
        "filename",
        F.when(F.length("filename") % 2 == 0, F.upper("sha256")).otherwise(F.sha2("filename", 256)).alias("sha256"),
    )
    gone = known.select(F.concat(F.lit("no-"), F.col("filename")).alias("filename"), "sha256")
    audited = readers.audit_checksums(spark, sf, known.unionByName(gone), "*.parquet")
    return audited.select("filename", "status")


def _stored(df: DataFrame, purpose: str) -> str:
    path = fresh_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return path


# Streams read their input a file at a time. Its rows are dealt over the files at random, so
# the lateness must span all of them; a last file holds one row that is late enough for the watermark to
# pass the others and whatever they still wait for.
_FILES, _WAIT_MS = 3, 3_600_000
# Sources or searches share the state of a bucket; its rows wait for the end of the input.
_LEAST_BUCKETS, _BUCKET_ROWS = 64, 50_000


def _shuffled(df: DataFrame, purpose: str, key: str, time: str, wait: str = "0L"):
    """The files' path, and what a stream over them takes: the lateness that the rows' times ask for, an
    origin that makes them positive, slices by which some ten timers meet a key, and as many buckets of
    keys as keep the rows of one few. `wait` is how long after its time a row may still cause something."""
    path = fresh_path(df.sparkSession, purpose)
    df.repartition(_FILES).write.parquet(path)
    n, first, last, longest = df.agg(
        F.count(F.lit(1)), F.min(time), F.max(time), F.max(F.coalesce(F.expr(wait), F.lit(0)))
    ).first()
    span = (last or 0) - (first or 0)
    slice_ms = max(1_000, span // 10)
    kinds = dict(df.dtypes)
    closing = {key: -1, time: (last or 0) + span + longest + 3 * slice_ms + _WAIT_MS}
    row = df.sparkSession.range(1).select(
        *[F.lit(closing.get(c)).cast(kinds[c]).alias(c) for c in df.columns]
    )
    row.coalesce(1).write.mode("append").parquet(path)
    return path, {
        "lateness": f"{span + 1_000} milliseconds",
        "origin_ms": _START_MS - min(0, first or 0),
        "slice_ms": slice_ms,
        "buckets": max(_LEAST_BUCKETS, n // _BUCKET_ROWS),
    }


def _drain(stream: DataFrame, purpose: str) -> DataFrame:
    """Run a stream over everything its input holds and return what it wrote."""
    spark = stream.sparkSession
    out = fresh_path(spark, purpose)
    query = sinks.write_event_log(stream, out, fresh_path(spark, f"{purpose}-checkpoint"))
    query.awaitTermination()
    late = streams.late_rows(query)
    if late:
        raise ValueError(f"{late} rows came after the watermark")
    return spark.read.schema(stream.schema).parquet(out)


def purge_store(spark, sf):
    """All vectors stored as targets of many searches; those of completed searches are erased."""
    targets = derived.table(spark, sf, "embeddings").selectExpr(
        "vec_id % 97 AS search_id", "vec_id AS target_id", "vec_id AS target_ord", "embedding"
    )
    path = fresh_path(spark, "gallery")
    gallery.add_targets(targets, path)
    ended = eventlog.search_status(derived.status_log(spark, sf), ended=False).where(
        "status = 'completed'"
    )
    gallery.purge_store(spark, path, ended, targets.schema)
    left = gallery.stored_targets(spark, path, targets.schema)
    return left.select(
        "search_id", "target_id", "target_ord", F.size("embedding").cast("bigint").alias("dims")
    )


def event_sink(spark, sf):
    log = eventlog.to_event_log(
        history._published(spark, sf), ["frame_id"], ["target_id", "track_id"]
    )
    stream = readers.stream_frames(spark, _stored(log, "log"), log.schema)
    return _drain(stream, "events").drop("event_id")


def latest_sink(spark, sf):
    e = derived.table(spark, sf, "events").select("user_id", "event_id", "event_type")
    stream = readers.stream_frames(
        spark, _stored(e, "payloads"), "user_id BIGINT, event_id BIGINT, event_type STRING"
    )
    out = fresh_path(spark, "latest")
    query = sinks.write_latest(
        stream, "user_id", "event_id", "event_type", fresh_path(spark, "latest-checkpoint"), out
    )
    query.awaitTermination()
    return eventlog.latest_per_key(spark.read.parquet(out), "user_id", "event_id", "event_type")


def confirm_stream(spark, sf):
    frames = v.frame_log(spark, sf).withColumn("search_id", F.lit(1).cast("bigint"))
    table = streams.as_sightings(history.seen(spark, sf), frames)
    path, how = _shuffled(table, "sightings", "source_id", "captured_ms")
    stream = readers.stream_frames(spark, path, schemas.SIGHTINGS, 1)
    events = _drain(streams.confirm_stream(stream, 0.25, **how), "confirmed")
    return events.select(
        "source_id", "target_id", "frame_id", "captured_ms", "state", "evidence_count",
        *r6("similarity"), *r8("quality"),
    )


def track_stream(spark, sf):
    path, how = _shuffled(derived.detections(spark, sf), "detections", "source_id", "captured_ms")
    stream = readers.stream_frames(spark, path, schemas.DETECTIONS, 1)
    tracks = _drain(streams.track_stream(stream, **how), "tracks")
    return tracks.select(
        "source_id", "frame_id", "track_id", *r6("x1", "y1", "x2", "y2", "score"), "missed"
    )


# Watermarks start at 0, the derived clock does too.
_START_MS = 1_704_067_200_000


def outage_stream(spark, sf):
    log = v.frame_log(spark, sf).select("source_id", "captured_ms")
    path, how = _shuffled(log, "frames", "source_id", "captured_ms", "1000L")
    stream = readers.stream_frames(spark, path, log.schema, 1)
    return _drain(streams.outage_stream(stream, 1000, **how), "outages")


def run_every_stream(spark, sf):
    log = v.frame_log(spark, sf)
    path, how = _shuffled(log, "cadence", "source_id", "captured_ms")
    stream = readers.stream_frames(spark, path, log.schema, 1)
    return _drain(streams.run_every_stream(stream, 5.0, **how), "runs").select("source_id", "frame_id")


def event_log_stream(spark, sf):
    """Events of all searches numbered while they come, and read back from the sink."""
    events = history._published(spark, sf)
    path, how = _shuffled(events, "published", "search_id", "occurred_at")
    stream = readers.stream_frames(spark, path, events.schema, 1)
    numbered = streams.event_log_stream(stream, ["frame_id"], ["target_id", "track_id"], **how)
    return _drain(numbered, "numbered").drop("event_id")


def tracks_as_of_stream(spark, sf):
    """Frames, detector runs and their tracks as three streams."""
    log = v.frame_log(spark, sf)
    tracks = derived.tracks0(spark, sf)
    inputs = []
    for name, rows in (("log", log), ("tracks", tracks), ("ticks", log)):
        if name != "log":
            rows = rows.where("frame_id % 3 = 0")
        path, how = _shuffled(rows, f"as-of-{name}", "source_id", "captured_ms")
        inputs.append((how, readers.stream_frames(spark, path, rows.schema, 1)))
    # The whole log spans the others.
    how = inputs[0][0]
    placed = streams.tracks_as_of_stream(*[stream for _, stream in inputs], idle_ms=None, **how)
    return _drain(placed, "as-of").select(
        "source_id", "frame_id", "tick_frame", "track_id", *r6("x1", "y1")
    )


def outcome_stream(spark, sf):
    started = v.search_list(spark, sf).join(
        v.search_targets(spark, sf).groupBy("search_id").agg(F.count(F.lit(1)).alias("total_count")),
        "search_id",
    )
    rows = started.selectExpr(
        "search_id", "'started' AS kind", "started_ms AS at_ms", "CAST(NULL AS BIGINT) AS target_id",
        "total_count", "timeout_ms",
    ).unionByName(
        v.search_events(spark, sf).selectExpr(
            "search_id",
            "CASE WHEN state = 'confirmed' AND (target_id < 3 OR (target_id = 3 AND search_id % 2 = 0))"
            " THEN 'confirmed' ELSE 'frame' END AS kind",
            "captured_ms AS at_ms", "target_id", "0L AS total_count", "0L AS timeout_ms",
        )
    )
    path, how = _shuffled(rows, "search-log", "search_id", "at_ms", "timeout_ms")
    stream = readers.stream_frames(spark, path, rows.schema, 1)
    return _drain(streams.outcome_stream(stream, **how), "outcomes")


def answer_stream(spark, sf):
    """Requests and ended searches as two streams, read from one log."""
    requests, ends = admit.timed_requests(spark, sf)
    log = requests.withColumn("kind", F.lit("request")).unionByName(
        ends.withColumnRenamed("ended_at", "at_ms").withColumn("kind", F.lit("end")),
        allowMissingColumns=True,
    )
    path, how = _shuffled(log, "requests", "request_id", "at_ms")
    ended = F.col("kind").eqNullSafe("end")
    stream = lambda: readers.stream_frames(spark, path, log.schema, 1)
    return _drain(
        streams.answer_stream(
            stream().where(~ended), stream().where(ended).withColumnRenamed("at_ms", "ended_at"), **how
        ),
        "answers",
    )


def dedupe_stream(spark, sf):
    requests = derived.table(spark, sf, "orders").selectExpr(
        "CAST(o_custkey AS STRING) AS request_id", "CAST(o_orderdate AS TIMESTAMP) AS at"
    )
    path = fresh_path(spark, "requests")
    requests.repartition(_FILES).write.parquet(path)
    stream = readers.stream_frames(spark, path, requests.schema, 1)
    # A lateness that spans all orders, so that each request id comes out once.
    days = requests.agg(F.datediff(F.max("at"), F.min("at"))).first()[0] or 0
    return _drain(streams.dedupe_stream(stream, "at", f"{days + 1} days"), "deduped").select("request_id")


QUERIES = {
    "manifest": (
        manifest,
        v.sql(
            """
 SELECT 'case-' || c.case_id AS case_id, 'case-' || c.case_id AS target_name, c.case_id % 2 = 0 AS absolute,
   c.case_id = 0 AS first_case, i.n, i.starts, i.ends
 FROM cases c LEFT JOIN (SELECT case_id, count(*) AS n, sum(start_ms)::BIGINT AS starts, sum(end_ms)::BIGINT AS ends
   FROM intervals GROUP BY case_id) i USING (case_id)"""
        ),
    ),
    "manifest_errors": (
        manifest_errors,
        v.sql(
            """
 SELECT code AS error_code, CASE WHEN m = 4 THEN 'c' || case_id END AS case_id, count(*) AS n
 FROM (SELECT case_id, case_id % 7 AS m, CASE case_id % 7 WHEN 1 THEN 'unreadable_manifest' WHEN 2 THEN 'no_cases'
   WHEN 3 THEN 'unsupported_version' WHEN 4 THEN 'interval_not_a_pair' END AS code FROM cases)
 WHERE code IS NOT NULL GROUP BY 1, 2"""
        ),
    ),
    "case_reports": (
        case_reports,
        v.sql(
            """
 SELECT case_id, threshold, expected_intervals, detected_intervals, false_confirmations, coalesce(n, 0) AS n_events,
   round(interval_recall, 6) AS interval_recall
 FROM case_metrics LEFT JOIN (SELECT case_id, threshold, count(*) AS n FROM confirmed GROUP BY ALL) USING (case_id, threshold)""",
            **scoring._CHAIN,
        ),
    ),
    "summary_report": (
        summary_report,
        v.sql(
            """
 SELECT 1::BIGINT AS schema_version, best AS recommended_similarity_threshold,
   CASE WHEN best IS NULL THEN 'failed_or_insufficient_data' ELSE 'passed' END AS status,
   0.8::DOUBLE AS minimum_interval_recall, threshold, passed, detected_intervals
 FROM metrics CROSS JOIN (SELECT first(threshold ORDER BY interval_recall DESC, false_confirmations_per_hour,
   mean_confirmation_latency_s, threshold DESC) AS best FROM metrics WHERE passed)""",
            **scoring._CHAIN,
            metrics=scoring._metrics_view(scoring.REACHABLE),
        ),
    ),
    "checksum_audit": (checksum_audit, None),
    "purge_store": (
        purge_store,
        v.sql(
            """
 SELECT vec_id % 97 AS search_id, vec_id AS target_id, vec_id AS target_ord, len(embedding) AS dims
 FROM embeddings WHERE vec_id % 97 NOT IN (SELECT search_id FROM last WHERE status = 'completed')""",
            last=history._LAST_STATUS,
        ),
    ),
    "event_sink": (event_sink, v.sql("SELECT * FROM log", log=history._LOG)),
    "latest_sink": (latest_sink, history.QUERIES["latest_per_key"][1]),
    "confirm_stream": (
        confirm_stream,
        v.sql(history._EVENT_SQL.format(more=""), **history.state_views([0.25], 3)),
    ),
    "track_stream": (track_stream, vision.TRACK_SQL),
    "outage_stream": (
        outage_stream,
        v.sql(
            f"""
 SELECT source_id, captured_ms AS at_ms, 'running' AS status FROM gaps WHERE lost_ms IS NULL OR captured_ms - lost_ms > 1000
 UNION ALL SELECT source_id, lost_ms + 1000, 'source_lost' FROM gaps WHERE captured_ms - lost_ms > 1000
 UNION ALL SELECT source_id, max(captured_ms) + 1000, 'source_lost' FROM frames GROUP BY source_id""",
            gaps=history._GAPS,
        ),
    ),
    "run_every_stream": (run_every_stream, history.QUERIES["run_every"][1]),
    "event_log_stream": (event_log_stream, history.QUERIES["event_log"][1]),
    "tracks_as_of_stream": (tracks_as_of_stream, vision.QUERIES["tracks_as_of"][1]),
    "outcome_stream": (
        outcome_stream,
        v.sql(
            f"""
 SELECT search_id, CASE WHEN found = total THEN complete_at ELSE timeout_ms END AS ended_at,
   CASE WHEN found = total THEN 'completed' ELSE 'timed_out' END AS status, found AS found_count, total AS total_count
 FROM (SELECT l.search_id, l.timeout_ms, count(t.target_id) AS total, count(f.at) AS found, max(f.at) AS complete_at
   FROM search_list l JOIN search_targets t USING (search_id) LEFT JOIN (
     SELECT e.search_id, e.target_id, min(e.captured_ms) AS at FROM search_events e JOIN search_list l USING (search_id)
     WHERE state = 'confirmed' AND (timeout_ms IS NULL OR captured_ms < timeout_ms) GROUP BY ALL) f
   ON f.search_id = t.search_id AND f.target_id = t.target_id GROUP BY l.search_id, l.timeout_ms)
 WHERE found = total OR timeout_ms IS NOT NULL""",
        ),
    ),
    "answer_stream": (answer_stream, admit.QUERIES["answer_requests"][1]),
    "dedupe_stream": (
        dedupe_stream,
        "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS request_id FROM orders",
    ),
}
