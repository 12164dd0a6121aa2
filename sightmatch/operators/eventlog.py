"""The event history of searches: numbering, replay, retention, status changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightmatch.functions import ordered
from sightmatch.params import EVENT_HISTORY, FRAME_QUEUE, TERMINAL_STATUSES


def combine_events(*events: DataFrame) -> DataFrame:
    """One table of events of different kinds; columns a kind lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), events)


def to_event_log(
    events: DataFrame, order: list[str], data: list[str], size: int = ordered.SLICE_MS
) -> DataFrame:
    """Envelopes numbered 1.. per search in publishing order.

    `events` has search_id, type, occurred_at (ms); `order` breaks ties of the time, `data`
    lists the payload columns.  Vectors are refused: they do not belong into histories.
    """
    _refuse_vectors(data)
    numbered = ordered.number_rows(events, ["search_id"], ["occurred_at", *order], "seq", size)
    return numbered.select(
        F.lit("1").alias("schema_version"),
        "search_id",
        "seq",
        F.expr("uuid()").alias("event_id"),
        "type",
        "occurred_at",
        F.to_json(F.struct(*data)).alias("data"),
    )


def _refuse_vectors(data: list[str]) -> None:
    if "embedding" in data:
        raise ValueError("event payloads must not hold vectors")


def envelopes(events: DataFrame, data: list[str], *more: str) -> DataFrame:
    """Events with their payload as text, before they are numbered."""
    _refuse_vectors(data)
    payload = F.to_json(F.struct(*data)).alias("data")
    return events.select("search_id", "occurred_at", "type", *more, payload)


def replay(log: DataFrame, after_seq: int = 0) -> DataFrame:
    """The envelopes after a sequence number, oldest first within each search."""
    return log.where(F.col("seq") > max(0, after_seq)).orderBy("search_id", "seq")


def last_per_key(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The n newest rows per key.  Spark applies the limit before the shuffle as well, so a
    busy key sends no more than n rows per task."""
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).drop("_n")


def retain_last(log: DataFrame, n: int = EVENT_HISTORY) -> DataFrame:
    return last_per_key(log, ["search_id"], "seq", n)


def newest_per_source(frames: DataFrame, n: int = FRAME_QUEUE) -> DataFrame:
    """The frames a reader that drops the oldest still holds."""
    return last_per_key(frames, ["source_id"], "frame_id", n)


def latest_per_key(df: DataFrame, key: str, seq: str, payload: str, after: int = 0) -> DataFrame:
    """Newest payload per key, for readers that have not seen it yet."""
    return (
        df.groupBy(key)
        .agg(F.max(seq).alias(seq), F.max_by(payload, seq).alias(payload))
        .where(F.col(seq) > after)
    )


def running_best(log: DataFrame) -> DataFrame:
    """Best similarity so far over candidate and confirmed events of each search."""
    shown = log.where(F.col("type").isin("candidate", "confirmed"))
    return ordered.running_max(
        shown, ["search_id"], "seq", "similarity", "best_similarity", ordered.SLICE_IDS
    )


def until_terminal(transitions: DataFrame) -> DataFrame:
    """Transitions up to and including the first terminal status of a search."""
    first = (
        transitions.where(F.col("status").isin(*TERMINAL_STATUSES))
        .groupBy("search_id")
        .agg(F.min("seq").alias("_last"))
    )
    return (
        transitions.join(first, "search_id", "left")
        .where(F.col("_last").isNull() | (F.col("seq") <= F.col("_last")))
        .drop("_last")
    )


def collapse_status(transitions: DataFrame) -> DataFrame:
    """Transitions (search_id, seq, status, error) that change something; none after the first
    terminal one.  A search begins as initializing, without error."""
    living = until_terminal(transitions).withColumn("_now", F.struct("status", "error"))
    linked = ordered.previous(
        living, ["search_id"], "seq", {"_was": "_now"}, ordered.SLICE_IDS
    )
    begin = F.struct(
        F.lit("initializing").alias("status"), F.lit(None).cast("string").alias("error")
    )
    return linked.where(
        ~F.col("_now").eqNullSafe(F.coalesce(F.col("_was"), begin))
    ).select(*transitions.columns)


def search_status(transitions: DataFrame, *, ended: bool = True) -> DataFrame:
    """Status of each search after its log.  With `ended` the log is complete, and a search
    that reached no terminal status counts as stopped."""
    living = until_terminal(transitions)
    last = living.groupBy("search_id").agg(
        F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq")
    )
    if not ended:
        return last
    terminal = F.col("status").isin(*TERMINAL_STATUSES)
    return last.withColumn("status", F.when(terminal, F.col("status")).otherwise("stopped"))
