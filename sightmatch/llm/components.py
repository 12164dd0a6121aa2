"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightmatch.sources.scratch import cut

#: Links that one task joins in its memory (some 30 MB); more go through star steps.
FEW_LINKS = 100_000


def _stars(links: DataFrame) -> DataFrame:
    """Links (high, low) after a large and a small star step: every neighbour above a node moves to
    the smallest one around it, then every node below does."""
    both = links.unionAll(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
    around = both.groupBy("high").agg(F.min("low").alias("least"))
    large = (
        both.join(around, "high")
        .filter(F.col("low") > F.col("high"))
        .select(F.col("low").alias("high"), F.least("least", "high").alias("low"))
        .distinct()
    )
    below = large.groupBy("high").agg(F.min("low").alias("least"))
    moved = large.join(below, "high").filter(F.col("low") != F.col("least"))
    return below.unionAll(moved.select("low", "least")).toDF("high", "low").distinct()


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, smallest node of its component) of a few links in one task."""
    up: dict = {}

    def root(node):
        while up.setdefault(node, node) != node:
            up[node] = node = up[up[node]]
        return node

    schema = None
    for batch in batches:
        schema = batch.schema
        for high, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            low, high = sorted((root(high), root(low)))
            up[high] = low
    if schema:
        rows = [(node, root(node)) for node in up if root(node) != node]
        for i in range(0, len(rows), 50_000):
            columns = zip(*rows[i : i + 50_000], strict=True)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (its smallest node) for each node of links that is not the smallest.

    Star steps alternate until nothing moves; both use aggregates that fold before the shuffle
    and joins that Spark may split, so a hub does not land in one task. Loops and repeated links
    change nothing, links with a null end are left out, without links there are no rows. Up to
    FEW_LINKS links are joined in one task at once."""
    now = cut(
        links.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))
        .distinct()
    )
    mark = F.struct(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("high", "low")).alias("x")
    )
    seen = now.agg(mark).first()[0]
    if seen["n"] <= FEW_LINKS:
        return now.coalesce(1).mapInArrow(_joined, now.schema).toDF("node", "component")
    while seen["n"]:
        now = cut(_stars(now))
        found = now.agg(mark).first()[0]
        if found == seen:
            break
        seen = found
    return now.select(F.col("high").alias("node"), F.col("low").alias("component"))


def least_labels(hits: np.ndarray, same: bool) -> np.ndarray:
    """Component number of each row and then each column of a matrix of links."""
    m, n = hits.shape
    label = np.arange(m + n)
    if same:
        label[m:] = label[:m]
    far = m + n
    while True:
        rows = np.minimum(label[:m], np.where(hits, label[m:], far).min(axis=1, initial=far))
        columns = np.minimum(label[m:], np.where(hits, rows[:, None], far).min(axis=0, initial=far))
        if same:
            rows = columns = np.minimum(rows, columns)
        new = np.concatenate([rows, columns])
        if (new == label).all():
            return label
        label = new
