"""Shards of bounded size by extendible hashing, with built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightmatch.sources.scratch import cut

#: Bits of the hash that lead the address, and of the row's position that follow them.
HASH_BITS, PLACE_BITS = 60, 60


def _bits(hexadecimal, n: int):
    return F.lpad(F.conv(F.substring(hexadecimal, 1, n // 4), 16, 2), n, "0")


def assign_shards(
    docs: DataFrame,
    shard_bytes: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, shard, depth, shard_bytes, shard_docs.

    A row's address is the first HASH_BITS bits of md5(id as text), a shard is a prefix of
    it ("shard": its bits as text, "depth": their number). The directory starts with as many bits as
    the whole size divided by the limit asks for; then only shards over the limit are split by their
    next bit, until each is within it. Only (id, size, address) are moved, and after the first
    round only rows of oversized shards.

    Defined cases: a document that is larger than the limit gets a shard of its own. Rows with the
    same id cannot be told apart by its hash; once a shard holds only one hash, the bits of the
    row's position in the table go on where the hash ends (docs must be a stored table). Null ids
    count as the text "null", null texts as empty; empty texts have 0 bytes. An empty table gives no
    rows. Other columns are ignored, whatever their names.
    """
    named = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    place = F.md5(F.monotonically_increasing_id().cast("string"))
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
            _bits(F.md5(named), HASH_BITS).alias("hash"),
            _bits(place, PLACE_BITS).alias("place"),
        )
    )
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    start = max(0, math.floor(math.log2(total / shard_bytes))) if total > shard_bytes else 0
    open_rows, done = rows.withColumn("depth", F.lit(start)), []
    while True:
        open_rows = open_rows.withColumn("shard", F.expr("substring(concat(hash, place), 1, depth)"))
        sizes = open_rows.groupBy("shard", "depth").agg(
            F.sum("n_bytes").alias("shard_bytes"),
            F.count(F.lit(1)).alias("shard_docs"),
            (F.min("hash") == F.max("hash")).alias("one_hash"),
        )
        sized = cut(open_rows.join(sizes, ["shard", "depth"]))
        fits = (
            (F.col("shard_bytes") <= shard_bytes)
            | (F.col("shard_docs") == 1)
            | (F.col("depth") >= HASH_BITS + PLACE_BITS)
        )
        done.append(
            sized.filter(fits).select(
                "doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs"
            )
        )
        rest = sized.filter(~fits)
        if rest.isEmpty():
            break
        # One hash alone: go on at the first bit of the position.
        deeper = F.when(F.col("one_hash"), F.greatest(F.col("depth"), F.lit(HASH_BITS))).otherwise(
            F.col("depth")
        )
        open_rows = rest.select("doc_id", "n_bytes", "hash", "place", (deeper + 1).alias("depth"))
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    return out


def directory(shards: DataFrame) -> DataFrame:
    """One row per shard of assign_shards: its prefix, depth, bytes and number of documents."""
    return shards.select("shard", "depth", "shard_bytes", "shard_docs").distinct()


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write docs as Parquet, a folder per shard. Ids must be unique."""
    place = shards.select(F.col("doc_id").alias("__id"), F.col("shard").alias("__shard"))
    (
        docs.join(place, docs[id_col].eqNullSafe(place["__id"]))
        .drop("__id")
        .repartition("__shard")
        .write.partitionBy("__shard")
        .parquet(path)
    )
