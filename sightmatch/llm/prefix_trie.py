"""The trie of conversation prefixes, accumulated over a minimal-perfect-hash node table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightmatch.llm.batches import small_batches
from sightmatch.llm.mixing import word_count
from sightmatch.llm.running import number
from sightmatch.llm.slots import SlotTable
from sightmatch.sources.scratch import cut

#: Turns of a conversation that are chained in one piece.
CHUNK = 1024
#: A subtree of more member turns than this, and than the share of all turns, is opened: its top is
#: accumulated apart.
SUBTREE_ROWS, OPEN_SHARE = 4_000, 200_000
#: Nodes in one task's arrays, about; opened nodes whose digests may be broadcast.
SHARD_NODES, SENT_NODES = 200_000, 500_000
#: Digests of the root and of nothing.
ROOT = bytes(16)
_ROOT = "X'" + ROOT.hex() + "'"
#: Conversation ids that are joined to one text before they are hashed.
ENDS_BITS = 16


def _short(digest: Column) -> Column:
    return F.unhex(F.substring(digest, 1, 32))


def ordered_turns(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """conv_id, nth (from 1), turn (digest of role and text), words: the turns in their order,
    null first. Ties are ordered by the role's and the text's first 64 characters, then by digest."""
    role = F.coalesce(F.col(role_col), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("place"),
        F.substring(role, 1, 64).alias("role_head"),
        F.substring(text, 1, 64).alias("text_head"),
        _short(
            F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
        ).alias("turn"),
        word_count(text).alias("words"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("place", "role_head", "text_head", "turn")]
    return number(rows, ["conv_id"], order).select("conv_id", "nth", "turn", "words")


def own_paths(turns: DataFrame) -> DataFrame:
    """The paths of the conversations as they are: turns with depth and length."""
    return spliced(turns, F.lit(0), F.col("conv_id"), 0)


def spliced(turns: DataFrame, take: Column, donor: Column, most: int) -> DataFrame:
    """conv_id, depth, turn, words, length: per conversation the first `take` (at most `most`)
    turns of conversation `donor`, then its own after its first `take`; both are expressions of conv_id.
    A row of depth 0 without a turn stands at each start."""
    chunk = F.shiftright(F.col("nth") - 1, 10).alias("chunk")
    heads = (
        turns.filter(F.col("nth") <= most)
        .groupBy(F.col("conv_id").alias("donor"))
        .agg(F.array_sort(F.collect_list(F.struct("nth", "turn", "words"))).alias("head"))
    )
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    wanted = sizes.withColumns({"take": take.cast("int"), "donor": donor})
    none = F.expr("cast(array() as array<struct<nth:bigint,turn:binary,words:bigint>>)")
    convs = cut(
        wanted.join(heads, "donor", "left")
        .withColumn("lent", F.slice(F.coalesce("head", none), F.lit(1), F.col("take")))
        .withColumn("given", F.size("lent").cast("long"))
        .select(
            "conv_id",
            "own",
            "take",
            "lent",
            "given",
            (F.col("given") + F.greatest(F.col("own") - F.col("take"), F.lit(0))).alias("length"),
        )
    )
    starts = convs.select(
        "conv_id",
        F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("binary").alias("turn"),
        F.lit(0).cast("long").alias("words"),
        "length",
    )
    lent = convs.select("conv_id", "length", F.inline("lent")).select(
        "conv_id", F.col("nth").alias("depth"), "turn", "words", "length"
    )
    # One row per piece of a conversation, so that no join key has more than CHUNK turns.
    pieces = convs.select(
        "conv_id",
        "take",
        "given",
        "length",
        F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("own") - 1, 10))).alias("chunk"),
    )
    own = (
        turns.withColumn("chunk", chunk)
        .join(pieces, ["conv_id", "chunk"])
        .filter("nth > take")
        .select("conv_id", (F.col("nth") - F.col("take") + F.col("given")).alias("depth"), "turn", "words", "length")
    )
    return starts.unionAll(lent).unionAll(own)


def _chained(key: str, value: str, start: bytes):
    """A step over batches sorted by `key`: per row the digest chain of `value` within the key, and the
    chain before the row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, link = None, start
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in key.split()], strict=True))
            before, after = [], []
            for k, v in zip(keys, batch.column(value).to_pylist(), strict=True):
                if k != last:
                    last, link = k, start
                before.append(link)
                link = hashlib.sha256(link + v).digest()[:16]
                after.append(link)
            columns = [*batch.columns, pa.array(before, pa.binary()), pa.array(after, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "before", "after"])

    return run


def _chain(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    keys = key.split()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, order)
    return small_batches(dealt).mapInArrow(
        _chained(key, value, ROOT), f"{schema}, before binary, after binary"
    )


def digests(paths: DataFrame) -> DataFrame:
    """paths with the digests of their prefixes: node and parent (null at depth 0).

    A prefix's digest depends on its turns alone: those of a piece of CHUNK are chained, and the result
    is hashed with the chain of the pieces before. Pieces are chained in parallel."""
    turns = paths.filter("depth > 0").withColumn("chunk", F.shiftright(F.col("depth") - 1, 10))
    chained = cut(_chain(turns, "conv_id chunk", "depth", "turn"))
    whole = chained.filter(f"depth % {CHUNK} = 0").select("conv_id", "chunk", "after")
    ends = _chain(whole.withColumnRenamed("after", "piece"), "conv_id", "chunk", "piece").select(
        "conv_id", (F.col("chunk") + 1).alias("chunk"), F.col("after").alias("base")
    )
    based = chained.join(ends, ["conv_id", "chunk"], "left")

    def with_base(link: str) -> Column:
        late = F.when(
            F.col(link) == F.expr(_ROOT), F.col("base")
        ).otherwise(_short(F.sha2(F.concat(F.col("base"), F.col(link)), 256)))
        return F.when(F.col("base").isNull(), F.col(link)).otherwise(late)

    end = F.when(F.col("depth") % CHUNK == 0, True).otherwise(False)
    nodes = based.withColumns({"node": with_base("after"), "parent": with_base("before")})
    # The last prefix of a piece is the base of the next one.
    bases = ends.select("conv_id", (F.col("chunk") - 1).alias("chunk"), F.col("base").alias("end_base"))
    nodes = nodes.join(bases, ["conv_id", "chunk"], "left").withColumn(
        "node", F.when(end, F.col("end_base")).otherwise(F.col("node"))
    )
    columns = ["conv_id", "depth", "turn", "words", "length", "parent", "node"]
    starts = paths.filter("depth = 0").withColumns(
        {"parent": F.lit(None).cast("binary"), "node": F.expr(_ROOT)}
    )
    return starts.select(columns).unionAll(nodes.select(columns))


_TOTALS = (
    "node binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long,"
    " n_leaves long, saved_tokens long, parent binary, is_top boolean"
)


def _words_of(column: pa.ChunkedArray) -> np.ndarray:
    """16-byte digests as pairs of numbers; null becomes the largest pair."""
    raw = b"".join(x if x is not None else b"\xff" * 16 for x in column.to_pylist())
    return np.frombuffer(raw, np.uint64).reshape(-1, 2)


def _accumulate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of whole subtrees: one slot per node, numbers scattered into flat arrays, added up
    through the slots of the parents from the deepest level on."""
    batches = list(batches)
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    keys = _words_of(table["node"])
    slots = SlotTable(keys)
    at = slots.find(keys)

    def scattered(name: str) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        out[at] = pc.fill_null(table[name], -1).to_numpy()
        return out

    parent = np.empty(len(keys), np.int64)
    parent[at] = slots.find(_words_of(table["parent"]))
    depth, convs, members = scattered("depth"), scattered("conv_id"), scattered("n_convs")
    inside = parent >= 0
    children = scattered("n_children") + np.bincount(parent[inside], minlength=len(keys))
    leaves = scattered("n_leaves") + (children == 0)
    saved = scattered("saved_tokens") + (members - 1) * scattered("words")
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
    for level in reversed(levels):
        level = level[inside[level]]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    parent_convs = np.where(inside, convs[parent], scattered("top_parent"))
    absent = ~inside & (depth == 0)
    for lo in range(0, len(keys), 10_000):
        here = at[lo : lo + 10_000]
        rows = table.slice(lo, 10_000)
        numbers = [x[here] for x in (members, children, leaves, saved)]
        yield pa.RecordBatch.from_arrays(
            [
                rows["node"].combine_chunks(),
                pa.array(convs[here]),
                pa.array(depth[here]),
                pa.array(parent_convs[here], mask=absent[here]),
                *map(pa.array, numbers),
                rows["parent"].combine_chunks(),
                pa.array(~inside[here]),
            ],
            ["node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "parent", "is_top"],
        )


def _hash_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (node, block): SHA-256 over each node's blocks, comma-joined."""
    last, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([last], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"]
        )

    for batch in batches:
        nodes, hashes = [], []
        for node, ids in zip(
            batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True
        ):
            if node == last:
                state.update(b"," + ids.encode())
                continue
            if last is not None:
                nodes.append(last)
                hashes.append(state.hexdigest())
            last, state = node, hashlib.sha256(ids.encode())
        if nodes:
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.binary()), pa.array(hashes)], ["node", "ends_sha256"]
            )
    if last is not None:
        yield row()


def _ends(rows: DataFrame) -> DataFrame:
    """node, ends_sha256 of the nodes at which paths end."""
    block = F.shiftright("conv_id", ENDS_BITS).alias("block")
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    blocks = (
        rows.filter("depth = length")
        .groupBy("node", block)
        .agg(F.array_join(ids, ",").alias("ids"))
        .repartition("node")
        .sortWithinPartitions("node", "block")
        .select("node", "ids")
    )
    return small_batches(blocks).mapInArrow(_hash_ends, "node binary, ends_sha256 string")


def prefix_nodes(paths: DataFrame, subtree_rows: int = SUBTREE_ROWS) -> DataFrame:
    """One row per distinct prefix of the paths (spliced or own_paths), the root included: conv_id (the
    smallest that starts with it), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256; (conv_id, depth) is a key.

    Prefixes are told apart by 128 bits of SHA-256; two nodes with one digest but other parents or
    turns would be found as equal keys of a slot table and raise. Nodes are counted by a grouping that
    combines before it shuffles. Subtrees with at most `subtree_rows` member turns (or the OPEN_SHARE-th
    part of all turns, if that is more) are dealt over shards by their tops; a shard accumulates its
    subtrees in flat arrays over a SlotTable. The nodes above, at most OPEN_SHARE a level, are
    accumulated the same way in one task, to which the tops below are added up per parent before.
    What ends at a node is hashed as a stream of blocks.

    Defined cases: rows without a conversation id belong to none and are left out. Null roles and texts
    are empty, null turns come first, repeated rows are further turns. Conversations whose path is empty are
    members of the root alone. An empty table gives no rows. Other columns are ignored.
    """
    rows = cut(digests(paths))
    nodes = cut(
        rows.groupBy("node", "parent", "turn").agg(
            F.count(F.lit(1)).alias("n_convs"),
            F.min("conv_id").alias("conv_id"),
            F.min("depth").alias("depth"),
            F.max("words").alias("words"),
            F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
        )
    )
    n_nodes, n_turns = nodes.agg(F.count(F.lit(1)), F.sum("n_convs")).first()
    is_heavy = F.col("weight") > max(subtree_rows, (n_turns or 0) // OPEN_SHARE)
    opened = nodes.filter(is_heavy)
    heavy = opened.select("node", F.col("conv_id").alias("opened"))
    n_heavy = heavy.count()
    marked = rows.join(F.broadcast(heavy) if n_heavy <= SENT_NODES else heavy, "node", "left")
    tops = marked.groupBy("conv_id").agg(
        F.min_by(
            F.when(F.col("opened").isNull(), F.xxhash64("node")),
            F.when(F.col("opened").isNull(), F.col("depth")),
        ).alias("shard"),
        F.max_by("opened", F.when(F.col("opened").isNotNull(), F.col("depth"))).alias("top_parent"),
    )
    zero = {c: F.lit(0).cast("long") for c in ("n_children", "n_leaves", "saved_tokens")}
    columns = ["node", "parent", "conv_id", "depth", "n_convs", "words", "top_parent", *zero]
    light = nodes.filter(~is_heavy).join(tops, "conv_id").withColumns(zero)
    shards = max(
        int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_nodes // SHARD_NODES
    )
    low = light.repartition(shards, "shard").select(columns).mapInArrow(_accumulate, _TOTALS)
    out = low = cut(low)
    if n_heavy:
        sums = (
            low.filter("is_top")
            .groupBy("parent")
            .agg(
                F.count(F.lit(1)).alias("n_children"),
                F.sum("n_leaves").alias("n_leaves"),
                F.sum("saved_tokens").alias("saved_tokens"),
            )
            .withColumnRenamed("parent", "node")
        )
        crown = opened.withColumn("top_parent", F.lit(None).cast("long"))
        crown = crown.join(sums, "node", "left").fillna(0, list(zero)).select(columns)
        out = low.unionAll(crown.coalesce(1).mapInArrow(_accumulate, _TOTALS))
    empty = hashlib.sha256().hexdigest()
    return out.join(_ends(rows), "node", "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )
