"""Queries over evidence, event histories and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from catalog.vision import r6, r8
from sightmatch.functions import ordered
from sightmatch.operators import eventlog, evidence, matching, searches
from sightmatch.params import EvidenceParams
from sightmatch.plans import pipelines
from sightmatch.sources import derived

THRESHOLDS = (0.20, 0.25, 0.30, 0.55)


def seen(spark, sf):
    best = matching.best_target(v.assessed(spark, sf).where("accepted"), derived.targets(spark, sf))
    return best.withColumn("track_id", F.col("source_id"))


def _events(spark, sf, thresholds, params=EvidenceParams()):
    swept = matching.sweep(seen(spark, sf), thresholds)
    return evidence.confirm(swept, v.frame_log(spark, sf), params)


def _event_columns(events, *more):
    return events.select(
        "source_id", "target_id", "frame_id", "captured_ms", "state", "evidence_count",
        *more, *r6("similarity"), *r8("quality"),
    )


def confirm(spark, sf):
    return _event_columns(_events(spark, sf, THRESHOLDS), "threshold")


def confirm_two(spark, sf):
    return _event_columns(_events(spark, sf, [0.25], EvidenceParams(required=2)))


# The evidence rules as a recursion over the observations of each key.  A loss between two
# observations, or after the last one, is stamped by the first frame at or after its deadline.
def state_views(thresholds, required, seen="seen"):
    values = ", ".join(f"{t}" for t in thresholds)
    return {
        "obs": f"""
 SELECT t.threshold, s.*, similarity >= threshold AS hit,
   row_number() OVER (PARTITION BY threshold, target_id, source_id, track_id ORDER BY frame_id) AS n,
   lead(frame_id) OVER (PARTITION BY threshold, target_id, source_id, track_id ORDER BY frame_id) AS next_frame
 FROM {seen} s CROSS JOIN (SELECT unnest([{values}])::DOUBLE AS threshold) t""",
        "deadlines": f"""
 SELECT o.source_id, o.frame_id AS hit_frame, f.frame_id AS due_frame, f.captured_ms AS due_ms FROM (
   SELECT o.source_id, o.frame_id, min(f.frame_id) AS due FROM (SELECT DISTINCT source_id, frame_id, captured_ms FROM {seen}) o
   JOIN frames f ON f.source_id = o.source_id AND f.captured_ms >= o.captured_ms + 2000 GROUP BY ALL) o
 JOIN frames f ON f.source_id = o.source_id AND f.frame_id = o.due""",
        # kept: evidence times; held: confirmed; shown: last candidate; due: deadline of the last hit.
        "walk": f"""
 SELECT threshold, target_id, source_id, track_id, 0::BIGINT AS n, []::BIGINT[] AS kept, false AS held,
   NULL::BIGINT AS shown, NULL::BIGINT AS due_frame, NULL::BIGINT AS due_ms,
   NULL::DOUBLE AS similarity, NULL::DOUBLE AS quality, NULL::BIGINT AS frame_id, NULL::BIGINT AS captured_ms,
   false AS candidate, false AS confirmed, false AS lost_before, false AS lost_at, NULL::BIGINT AS lost_frame,
   NULL::BIGINT AS lost_ms, NULL::DOUBLE AS lost_similarity, NULL::DOUBLE AS lost_quality
 FROM obs WHERE n = 1
 UNION ALL
 SELECT threshold, target_id, source_id, track_id, n,
   CASE WHEN lost_at THEN [] ELSE kept END,
   CASE WHEN lost_at THEN false ELSE held OR confirmed END,
   CASE WHEN lost_at THEN NULL WHEN candidate THEN captured_ms ELSE shown END,
   CASE WHEN lost_at THEN NULL ELSE due_frame END, CASE WHEN lost_at THEN NULL ELSE due_ms END,
   similarity, quality, frame_id, captured_ms, candidate, confirmed, lost_before, lost_at, lost_frame, lost_ms,
   lost_similarity, lost_quality
 FROM (
   SELECT *, CASE WHEN hit AND NOT held AND (shown IS NULL OR captured_ms - shown >= 500) THEN true ELSE false END AS candidate,
     coalesce(hit AND NOT held AND len(kept) >= {required}, false) AS confirmed,
     coalesce(held AND NOT hit AND old_due_frame = frame_id, false) AS lost_at,
     CASE WHEN hit THEN new_due_frame ELSE old_due_frame END AS due_frame,
     CASE WHEN hit THEN new_due_ms ELSE old_due_ms END AS due_ms,
     CASE WHEN lost_before OR (held AND NOT hit AND old_due_frame = frame_id) THEN old_frame END AS lost_frame,
     CASE WHEN lost_before OR (held AND NOT hit AND old_due_frame = frame_id) THEN old_ms END AS lost_ms,
     CASE WHEN lost_before THEN old_similarity ELSE similarity END AS lost_similarity,
     CASE WHEN lost_before THEN old_quality ELSE quality END AS lost_quality
   FROM (
     SELECT o.threshold, o.target_id, o.source_id, o.track_id, o.n, o.hit, o.similarity, o.quality, o.frame_id, o.captured_ms,
       w.similarity AS old_similarity, w.quality AS old_quality, w.due_frame AS old_frame, w.due_ms AS old_ms,
       coalesce(w.held AND w.due_frame < o.frame_id, false) AS lost_before,
       CASE WHEN coalesce(w.held AND w.due_frame < o.frame_id, false) THEN NULL ELSE w.due_frame END AS old_due_frame,
       CASE WHEN coalesce(w.held AND w.due_frame < o.frame_id, false) THEN NULL ELSE w.due_ms END AS old_due_ms,
       w.held AND NOT coalesce(w.held AND w.due_frame < o.frame_id, false) AS held,
       CASE WHEN coalesce(w.held AND w.due_frame < o.frame_id, false) THEN NULL ELSE w.shown END AS shown,
       d.due_frame AS new_due_frame, d.due_ms AS new_due_ms,
       CASE WHEN NOT o.hit THEN w.kept
         WHEN len(list_filter(w.kept, lambda k: o.captured_ms - k <= 1500)) = 0
           OR o.captured_ms - list_max(w.kept) >= 200
         THEN list_append(list_filter(w.kept, lambda k: o.captured_ms - k <= 1500), o.captured_ms)
         ELSE list_filter(w.kept, lambda k: o.captured_ms - k <= 1500) END AS kept
     FROM walk w JOIN obs o ON o.threshold = w.threshold AND o.target_id = w.target_id
       AND o.source_id = w.source_id AND o.track_id = w.track_id AND o.n = w.n + 1
     LEFT JOIN deadlines d ON d.source_id = o.source_id AND d.hit_frame = o.frame_id))""",
        "told": """
 SELECT threshold, source_id, track_id, target_id, frame_id, captured_ms, 'candidate' AS state, similarity, quality,
   len(kept) AS evidence_count FROM walk WHERE candidate
 UNION ALL SELECT threshold, source_id, track_id, target_id, frame_id, captured_ms, 'confirmed', similarity, quality, len(kept)
 FROM walk WHERE confirmed
 UNION ALL SELECT threshold, source_id, track_id, target_id, lost_frame, lost_ms, 'lost', lost_similarity, lost_quality, 0
 FROM walk WHERE lost_before OR lost_at
 UNION ALL SELECT threshold, source_id, track_id, target_id, due_frame, due_ms, 'lost', similarity, quality, 0 FROM (
   SELECT *, row_number() OVER (PARTITION BY threshold, target_id, source_id, track_id ORDER BY n DESC) AS last FROM walk)
 WHERE last = 1 AND held AND due_frame IS NOT NULL""",
    }


_EVENT_SQL = (
    "SELECT {more}source_id, target_id, frame_id, captured_ms, state, CAST(evidence_count AS BIGINT) AS evidence_count,"
    " round(similarity, 6) AS similarity, round(quality, 8) AS quality FROM told"
)


_LIVE = {
    "placed": """
 SELECT a.*, m.target_id, m.similarity, t.track_id, row_number() OVER (PARTITION BY a.source_id, a.frame_id, a.face_idx
   ORDER BY (t.x2-t.x1)*(t.y2-t.y1), t.track_id) AS n
 FROM accepted a JOIN top1 m USING (vec_id) JOIN tracks0 t ON a.source_id = t.source_id AND a.frame_id = t.frame_id
   AND (a.x1+a.x2)/2 BETWEEN t.x1 AND t.x2 AND (a.y1+a.y2)/2 BETWEEN t.y1 AND t.y1 + 0.6*(t.y2-t.y1)
 WHERE m.similarity >= 0.20""",
    "seen_live": """
 SELECT source_id, track_id, target_id, frame_id, captured_ms, similarity, quality FROM placed WHERE n = 1""",
    **state_views([0.20], 3, "seen_live"),
    "live": """
 SELECT t.* FROM told t LEFT JOIN (
   SELECT target_id, min(captured_ms) AS first FROM told WHERE state = 'confirmed' GROUP BY target_id) f USING (target_id)
 WHERE f.first IS NULL OR t.captured_ms <= f.first""",
}


def live_search(spark, sf):
    """A live search over the derived tracks; found targets are retired."""
    events = pipelines.live_search(
        v.assessed(spark, sf),
        derived.tracks0(spark, sf),
        v.frame_log(spark, sf),
        derived.targets(spark, sf),
        0.20,
    )
    return events.select(
        "source_id", "target_id", "track_id", "frame_id", "state", "evidence_count",
        *r6("similarity"),
    )


def event_history(spark, sf):
    events = pipelines.live_search(
        v.assessed(spark, sf),
        derived.tracks0(spark, sf),
        v.frame_log(spark, sf),
        derived.targets(spark, sf),
        0.20,
    )
    return pipelines.event_history(events, 256).drop("event_id", "data")


def evidence_with_box(spark, sf):
    """Every face counts for both tracks of its source."""
    numbers = F.array(*[F.col("source_id") * 10 + det for det in (0, 2)])
    both = seen(spark, sf).withColumn("track_id", F.explode(numbers))
    events = evidence.confirm(both, v.frame_log(spark, sf), threshold=0.25)
    boxed = evidence.with_track_box(events, derived.tracks0(spark, sf))
    return boxed.select(
        "source_id", "target_id", "track_id", "frame_id", "state",
        F.round("bbox.x1", 6).alias("x1"), F.round("bbox.y2", 6).alias("y2"),
    )


def thin_evidence(spark, sf):
    thinned = evidence.thin_evidence(seen(spark, sf))
    return thinned.select("source_id", "target_id", "frame_id", "kept", "evidence_count")


_GREEDY = """
 SELECT {key}, n, frame_id, captured_ms, captured_ms AS last, true AS kept FROM {rows} WHERE n = 1
 UNION ALL
 SELECT {qualified}, r.n, r.frame_id, r.captured_ms,
   CASE WHEN r.captured_ms - g.last >= {gap} THEN r.captured_ms ELSE g.last END, r.captured_ms - g.last >= {gap}
 FROM greedy g JOIN {rows} r ON {join} AND r.n = g.n + 1"""


def _greedy(rows, keys, gap):
    return _GREEDY.format(
        rows=rows,
        key=", ".join(keys),
        qualified=", ".join(f"r.{k}" for k in keys),
        join=" AND ".join(f"r.{k} = g.{k}" for k in keys),
        gap=gap,
    )


_FRAME_ROWS = "SELECT *, frame_id + 1 AS n FROM frames"


def throttle(spark, sf):
    kept = evidence.throttle(v.frame_log(spark, sf), ["source_id"], "frame_id", "captured_ms", 500)
    return kept.select("source_id", "frame_id")


def throttle_sliced(spark, sf):
    """The same rule with slices of two seconds, so that every source spans many of them."""
    kept = evidence.throttle(
        v.frame_log(spark, sf), ["source_id"], "frame_id", "captured_ms", 500, size=2000
    )
    return kept.select("source_id", "frame_id")


def run_every(spark, sf):
    return evidence.run_every(v.frame_log(spark, sf), 5.0).select("source_id", "frame_id")


def _greedy_sql(gap):
    return v.sql(
        "SELECT source_id, frame_id FROM greedy WHERE kept",
        frame_rows=_FRAME_ROWS,
        greedy=_greedy("frame_rows", ["source_id"], gap),
    )


# --- histories ---------------------------------------------------------------------------


def _published(spark, sf):
    return v.search_events(spark, sf).select(
        "search_id",
        F.col("captured_ms").alias("occurred_at"),
        F.col("state").alias("type"),
        "target_id",
        "track_id",
        "frame_id",
        "similarity",
    )


def _log(spark, sf):
    return eventlog.to_event_log(_published(spark, sf), ["frame_id"], ["target_id", "track_id"])


def event_log(spark, sf):
    return _log(spark, sf).drop("event_id")


_LOG = """
 SELECT '1' AS schema_version, search_id, seq, type, occurred_at,
   '{"target_id":' || target_id || ',"track_id":' || track_id || '}' AS data FROM numbered"""


def replay(spark, sf):
    return eventlog.replay(_log(spark, sf), 10).drop("event_id")


def retain_last(spark, sf):
    return eventlog.retain_last(_log(spark, sf), 30).select("search_id", "seq", "type")


def running_best(spark, sf):
    numbered = ordered.number_rows(
        _published(spark, sf), ["search_id"], ["occurred_at", "frame_id"], "seq"
    )
    return eventlog.running_best(numbered).select("search_id", "seq", *r6("best_similarity"))


def collapse_status(spark, sf):
    kept = eventlog.collapse_status(derived.status_log(spark, sf))
    return kept.select("search_id", "seq", "status", "error")


def search_status(spark, sf):
    return eventlog.search_status(derived.status_log(spark, sf))


def active_searches(spark, sf):
    now = eventlog.search_status(derived.status_log(spark, sf), ended=False)
    return searches.active_searches(now).select("search_id", "status")


def get_searches(spark, sf):
    views = eventlog.search_status(derived.status_log(spark, sf)).drop("seq")
    ids = derived.table(spark, sf, "customer").select(F.col("c_custkey").alias("search_id"))
    return searches.get_searches(ids, views)


_LAST_STATUS = """
 SELECT search_id, status, seq FROM (
   SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY seq DESC) AS m FROM (
     SELECT s.*, min(CASE WHEN status = 'completed' THEN seq END) OVER (PARTITION BY search_id) AS stop FROM status_log s)
   WHERE stop IS NULL OR seq <= stop) WHERE m = 1"""


def latest_per_key(spark, sf):
    e = derived.table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return eventlog.latest_per_key(e, "user_id", "event_id", "event_type")


def newest_per_source(spark, sf):
    return eventlog.newest_per_source(v.frame_log(spark, sf))


def combine_events(spark, sf):
    e = v.search_events(spark, sf)
    found = searches.target_found_events(searches.retire_found(e))
    status = derived.status_log(spark, sf).select(
        "search_id", F.col("seq").alias("frame_id"), F.col("status").alias("state")
    )
    both = eventlog.combine_events(found, status)
    return both.select("search_id", "frame_id", "state", "target_id")


# --- searches ----------------------------------------------------------------------------


def retire_found(spark, sf):
    kept = searches.retire_found(v.search_events(spark, sf))
    return kept.select("search_id", "target_id", "frame_id", "state")


_RETIRED = """
 SELECT e.* FROM search_events e LEFT JOIN (
   SELECT search_id, target_id, min(captured_ms) AS first FROM search_events WHERE state = 'confirmed' GROUP BY ALL) f
 USING (search_id, target_id) WHERE f.first IS NULL OR e.captured_ms <= f.first"""


def unfound_targets(spark, sf):
    return searches.unfound_targets(v.search_targets(spark, sf), v.search_events(spark, sf)).select(
        "search_id", "target_id"
    )


def best_similarity(spark, sf):
    best = searches.best_similarity(v.search_events(spark, sf))
    return best.select("search_id", "target_id", *r6("best_similarity"))


def target_views(spark, sf):
    views = searches.target_views(
        v.search_targets(spark, sf), searches.retire_found(v.search_events(spark, sf))
    )
    return views.select(
        "search_id", "target_id", "name", "status", "found_at", *r6("best_similarity")
    )


_TARGET_VIEWS = """
 SELECT t.search_id, t.target_id, t.target_ord, t.name, CASE WHEN e.found_at IS NULL THEN 'searching' ELSE 'found' END AS status,
   e.found_at, e.best AS best_similarity
 FROM search_targets t LEFT JOIN (
   SELECT search_id, target_id, max(CASE WHEN state = 'confirmed' THEN captured_ms END) AS found_at, max(similarity) AS best
   FROM retired GROUP BY ALL) e USING (search_id, target_id)"""


def search_view(spark, sf):
    view = searches.search_view(
        v.search_list(spark, sf).select("search_id", "timeout_ms"),
        v.search_targets(spark, sf),
        searches.retire_found(v.search_events(spark, sf)),
    )
    label = F.transform("targets", lambda t: F.concat(t["name"], F.lit("="), t["status"]))
    return view.select(
        "search_id",
        "timeout_ms",
        "found_count",
        "total_count",
        F.array_join("unfound_target_ids", ",").alias("unfound"),
        F.array_join(label, ";").alias("targets"),
    )


def _outcomes(spark, sf):
    return searches.search_outcomes(
        v.search_list(spark, sf), v.search_targets(spark, sf), v.search_events(spark, sf)
    )


def search_outcomes(spark, sf):
    return _outcomes(spark, sf).withColumn(
        "unfound_target_ids", F.array_join("unfound_target_ids", ",")
    )


_OUTCOMES = """
 SELECT l.search_id, total_count, found_count, last_found, unfound,
   found_count = total_count AS complete, coalesce(ended_ms >= timeout_ms, false) AS late, timeout_ms, ended_ms
 FROM search_list l JOIN (
   SELECT t.search_id, count(*) AS total_count, count(f.at) AS found_count, max(f.at) AS last_found,
     coalesce(string_agg(CASE WHEN f.at IS NULL THEN t.target_id END, ',' ORDER BY t.target_id), '') AS unfound
   FROM search_targets t LEFT JOIN (
     SELECT e.search_id, e.target_id, min(e.captured_ms) AS at FROM search_events e JOIN search_list l USING (search_id)
     WHERE state = 'confirmed' AND (timeout_ms IS NULL OR captured_ms < timeout_ms) GROUP BY ALL) f
   USING (search_id, target_id) GROUP BY t.search_id) c USING (search_id)"""

_ENDED_AT = "CASE WHEN complete THEN last_found WHEN late THEN timeout_ms ELSE ended_ms END"


def _found(spark, sf):
    due = v.search_list(spark, sf).select("search_id", "timeout_ms")
    return (
        searches.target_found_events(searches.retire_found(v.search_events(spark, sf)))
        .join(v.search_targets(spark, sf).select("search_id", "target_id", "target_ord"),
              ["search_id", "target_id"])
        .join(due, "search_id")
        .where("timeout_ms IS NULL OR captured_ms < timeout_ms")
    )


def terminal_events(spark, sf):
    events = searches.terminal_events(_outcomes(spark, sf), _found(spark, sf))
    log = eventlog.to_event_log(events, ["phase", "ord", "sub_ord"], ["detail"])
    return log.drop("event_id", "data")


_FOUND = """
 SELECT r.search_id, r.target_id, r.captured_ms FROM retired r JOIN search_targets USING (search_id, target_id)
 JOIN search_list l USING (search_id)
 WHERE state = 'confirmed' AND (timeout_ms IS NULL OR captured_ms < timeout_ms)"""


def track_states(spark, sf):
    states = v.search_events(spark, sf).where("state <> 'lost'").selectExpr(
        "search_id AS source_id", "frame_id div 4 AS frame_id", "track_id",
        "target_id*100 + frame_id AS target_ord", "state", "similarity",
    )
    shown = searches.track_states(states)
    return shown.select("source_id", "frame_id", "track_id", "state", *r6("similarity"))


def search_metrics(spark, sf):
    e = derived.table(spark, sf, "events")
    latencies = e.select(
        F.col("event_type").alias("search_id"),
        F.col("event_id").alias("frame_id"),
        F.col("value").alias("latency_ms"),
    )
    elapsed = e.groupBy(F.col("event_type").alias("search_id")).agg(
        ((F.max("event_id") - F.min("event_id")) * 10).alias("elapsed_ms")
    )
    return searches.search_metrics(latencies, elapsed).select(
        "search_id", *r6("processed_fps", "p95_latency_ms")
    )


def dropped_frames(spark, sf):
    arrived = derived.frames(spark, sf).where("event_type <> 'view'")
    return searches.dropped_frames(arrived)


def source_outages(spark, sf):
    return searches.source_transitions(v.frame_log(spark, sf), 1000)


_GAPS = """
 SELECT *, lag(captured_ms) OVER (PARTITION BY source_id ORDER BY frame_id) AS lost_ms FROM frames"""


def purge_targets(spark, sf):
    ended = eventlog.search_status(derived.status_log(spark, sf), ended=False).where(
        "status = 'completed'"
    )
    return searches.purge_targets(v.search_targets(spark, sf), ended).select(
        "search_id", "target_id"
    )


def deletable(spark, sf):
    now = eventlog.search_status(derived.status_log(spark, sf), ended=False)
    active = searches.active_searches(now)
    return searches.deletable(v.search_targets(spark, sf), active).select(
        "search_id", "target_id", "in_use"
    )


QUERIES = {
    "confirm": (
        confirm,
        v.sql(_EVENT_SQL.format(more="threshold, "), **state_views(THRESHOLDS, 3)),
    ),
    "confirm_required_two": (
        confirm_two,
        v.sql(_EVENT_SQL.format(more=""), **state_views([0.25], 2)),
    ),
    "evidence_with_box": (
        evidence_with_box,
        v.sql(
            """
 SELECT e.source_id, e.target_id, e.track_id, e.frame_id, e.state, round(t.x1, 6) AS x1, round(t.y2, 6) AS y2
 FROM told e JOIN tracks0 t ON t.source_id = e.source_id AND t.frame_id = e.frame_id AND t.track_id = e.track_id""",
            seen_both="""
 SELECT s.* REPLACE (s.source_id*10 + d.det AS track_id) FROM seen s CROSS JOIN (SELECT unnest([0, 2]) AS det) d""",
            **state_views([0.25], 3, "seen_both"),
        ),
    ),
    "live_search": (
        live_search,
        v.sql(
            """
 SELECT source_id, target_id, track_id, frame_id, state, CAST(evidence_count AS BIGINT) AS evidence_count,
   round(similarity, 6) AS similarity FROM live""",
            **_LIVE,
        ),
    ),
    "event_history": (
        event_history,
        v.sql(
            """
 SELECT '1' AS schema_version, 1::BIGINT AS search_id, seq, state AS type, captured_ms AS occurred_at FROM (
   SELECT *, row_number() OVER (ORDER BY captured_ms, frame_id, target_id, track_id, state) AS seq, count(*) OVER () AS n
   FROM live) WHERE seq > n - 256""",
            **_LIVE,
        ),
    ),
    "thin_evidence": (
        thin_evidence,
        v.sql(
            """
 SELECT a.source_id, a.target_id, a.frame_id, a.kept,
   count(*) FILTER (WHERE b.kept AND b.captured_ms BETWEEN a.captured_ms - 1500 AND a.captured_ms) AS evidence_count
 FROM greedy a JOIN greedy b ON a.source_id = b.source_id AND a.target_id = b.target_id
 GROUP BY a.source_id, a.target_id, a.frame_id, a.kept""",
            seen_rows="SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY frame_id) AS n FROM seen",
            greedy=_greedy("seen_rows", ["source_id", "target_id"], 200),
        ),
    ),
    "throttle": (throttle, _greedy_sql(500)),
    "throttle_sliced": (throttle_sliced, _greedy_sql(500)),
    "run_every": (run_every, _greedy_sql(200)),
    "event_log": (event_log, v.sql("SELECT * FROM log", log=_LOG)),
    "replay": (replay, v.sql("SELECT * FROM log WHERE seq > 10", log=_LOG)),
    "retain_last": (
        retain_last,
        v.sql(
            """
 SELECT search_id, seq, type FROM (
   SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY seq DESC) AS m FROM numbered) WHERE m <= 30"""
        ),
    ),
    "running_best": (
        running_best,
        v.sql(
            """
 SELECT search_id, seq, round(max(similarity) OVER (PARTITION BY search_id ORDER BY seq), 6) AS best_similarity
 FROM numbered WHERE type IN ('candidate', 'confirmed')"""
        ),
    ),
    "collapse_status": (
        collapse_status,
        v.sql(
            """
 SELECT search_id, seq, status, error FROM (
   SELECT *, lag(status, 1, 'initializing') OVER w AS s0, lag(error) OVER w AS e0 FROM (
     SELECT s.*, min(CASE WHEN status = 'completed' THEN seq END) OVER (PARTITION BY search_id) AS stop FROM status_log s)
   WHERE stop IS NULL OR seq <= stop WINDOW w AS (PARTITION BY search_id ORDER BY seq))
 WHERE status IS DISTINCT FROM s0 OR error IS DISTINCT FROM e0"""
        ),
    ),
    "search_status": (
        search_status,
        v.sql(
            "SELECT search_id, seq, CASE WHEN status = 'completed' THEN status ELSE 'stopped' END AS status FROM last",
            last=_LAST_STATUS,
        ),
    ),
    "active_searches": (
        active_searches,
        v.sql("SELECT search_id, status FROM last WHERE status <> 'completed'", last=_LAST_STATUS),
    ),
    "get_searches": (
        get_searches,
        v.sql(
            """
 SELECT c.c_custkey AS search_id, CASE WHEN status = 'completed' THEN status WHEN status IS NOT NULL THEN 'stopped' END AS status,
   CASE WHEN l.search_id IS NULL THEN 'search_not_found' END AS error_code
 FROM customer c LEFT JOIN last l ON l.search_id = c.c_custkey""",
            last=_LAST_STATUS,
        ),
    ),
    "latest_per_key": (
        latest_per_key,
        "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type"
        " FROM events GROUP BY user_id",
    ),
    "newest_per_source": (
        newest_per_source,
        v.sql(
            """
 SELECT source_id, frame_id, captured_ms FROM (
   SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY frame_id DESC) AS m FROM frames) WHERE m <= 2"""
        ),
    ),
    "combine_events": (
        combine_events,
        v.sql(
            """
 SELECT search_id, frame_id, 'target_found' AS state, target_id FROM retired WHERE state = 'confirmed'
 UNION ALL SELECT search_id, seq, status, NULL FROM status_log""",
            retired=_RETIRED,
        ),
    ),
    "retire_found": (
        retire_found,
        v.sql("SELECT search_id, target_id, frame_id, state FROM retired", retired=_RETIRED),
    ),
    "unfound_targets": (
        unfound_targets,
        v.sql(
            """
 SELECT search_id, target_id FROM search_targets t WHERE NOT EXISTS (
   SELECT 1 FROM search_events e WHERE e.search_id = t.search_id AND e.target_id = t.target_id AND state = 'confirmed')"""
        ),
    ),
    "best_similarity": (
        best_similarity,
        v.sql(
            "SELECT search_id, target_id, round(max(similarity), 6) AS best_similarity"
            " FROM search_events GROUP BY ALL"
        ),
    ),
    "target_views": (
        target_views,
        v.sql(
            "SELECT search_id, target_id, name, status, found_at, round(best_similarity, 6) AS best_similarity FROM tv",
            retired=_RETIRED,
            tv=_TARGET_VIEWS,
        ),
    ),
    "search_view": (
        search_view,
        v.sql(
            """
 SELECT search_id, any_value(timeout_ms) AS timeout_ms, count(found_at) AS found_count, count(*) AS total_count,
   coalesce(string_agg(CASE WHEN status <> 'found' THEN target_id END, ',' ORDER BY target_ord), '') AS unfound,
   string_agg(name || '=' || status, ';' ORDER BY target_ord) AS targets
 FROM tv JOIN search_list USING (search_id) GROUP BY search_id""",
            retired=_RETIRED,
            tv=_TARGET_VIEWS,
        ),
    ),
    "search_outcomes": (
        search_outcomes,
        v.sql(
            f"""
 SELECT search_id, CASE WHEN complete THEN 'completed' WHEN late THEN 'timed_out' ELSE 'stopped' END AS status,
   CASE WHEN complete THEN 'all_found' WHEN late THEN 'search_timeout' END AS event_type,
   {_ENDED_AT} AS ended_at, found_count, total_count, unfound AS unfound_target_ids FROM outcomes""",
            outcomes=_OUTCOMES,
        ),
    ),
    "terminal_events": (
        terminal_events,
        v.sql(
            f"""
 SELECT '1' AS schema_version, search_id, type, ended AS occurred_at,
   row_number() OVER (PARTITION BY search_id ORDER BY phase, at_ms, target_id) AS seq FROM (
   SELECT search_id, 'search_status' AS type, {_ENDED_AT} AS ended, 1 AS phase, 0 AS at_ms, 0 AS target_id FROM outcomes
   UNION ALL SELECT search_id, 'target_found', {_ENDED_AT}, 2, f.captured_ms, f.target_id FROM found f JOIN outcomes USING (search_id)
   UNION ALL SELECT search_id, CASE WHEN complete THEN 'all_found' ELSE 'search_timeout' END, {_ENDED_AT}, 3, 0, 0
   FROM outcomes WHERE complete OR late)""",
            retired=_RETIRED,
            outcomes=_OUTCOMES,
            found=_FOUND,
        ),
    ),
    "track_states": (
        track_states,
        v.sql(
            """
 SELECT source_id, frame_id, track_id, state, round(similarity, 6) AS similarity FROM (
   SELECT search_id AS source_id, frame_id//4 AS frame_id, track_id, state, similarity, row_number() OVER (
     PARTITION BY search_id, frame_id//4, track_id ORDER BY (state = 'confirmed')::INT DESC, target_id*100 + frame_id DESC) AS m
   FROM search_events WHERE state <> 'lost') WHERE m = 1"""
        ),
    ),
    "search_metrics": (
        search_metrics,
        """
 SELECT event_type AS search_id, round(n/greatest((b-a)*10/1000.0, 1e-6), 6) AS processed_fps, round(p, 6) AS p95_latency_ms
 FROM (SELECT event_type, count(*) AS n, min(event_id) AS a, max(event_id) AS b FROM events GROUP BY ALL)
 JOIN (SELECT event_type, quantile_cont(value, 0.95) AS p FROM (
   SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS m FROM events) WHERE m <= 1000 GROUP BY ALL)
 USING (event_type)""",
    ),
    "dropped_frames": (
        dropped_frames,
        v.sql(
            """
 SELECT source_id, CAST(sum(coalesce(frame_id - before - 1, 0)) AS BIGINT) AS dropped_frames FROM (
   SELECT source_id, frame_id, lag(frame_id) OVER (PARTITION BY source_id ORDER BY frame_id) AS before
   FROM frames WHERE event_type <> 'view') GROUP BY source_id"""
        ),
    ),
    "source_transitions": (
        source_outages,
        v.sql(
            """
 SELECT source_id, captured_ms AS at_ms, 'running' AS status FROM gaps WHERE lost_ms IS NULL OR captured_ms - lost_ms > 1000
 UNION ALL SELECT source_id, lost_ms + 1000, 'source_lost' FROM gaps WHERE captured_ms - lost_ms > 1000""",
            gaps=_GAPS,
        ),
    ),
    "purge_targets": (
        purge_targets,
        v.sql(
            """
 SELECT search_id, target_id FROM search_targets
 WHERE search_id NOT IN (SELECT search_id FROM last WHERE status = 'completed')""",
            last=_LAST_STATUS,
        ),
    ),
    "deletable": (
        deletable,
        v.sql(
            """
 SELECT search_id, target_id, search_id IN (SELECT search_id FROM last WHERE status <> 'completed') AS in_use
 FROM search_targets""",
            last=_LAST_STATUS,
        ),
    ),
}
