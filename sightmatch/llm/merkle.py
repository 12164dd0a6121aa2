"""A Merkle manifest of a table: bitmap ranks place the leaves, slot arrays reduce the levels."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightmatch.llm.running import number, spread_join
from sightmatch.sources.scratch import cut

#: Children of a node; levels that one task reduces at once, and the leaves of such a block.
FAN, LEVELS = 8, 4
BLOCK = FAN**LEVELS
#: Ids of one bitmap word, and of one stretch of the directory, as powers of two.
WORD_BITS, STRETCH_BITS = 6, 21


def field(value: Column) -> Column:
    """A value as it enters a leaf: `-` if null, else its length in bytes, `:`, itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


# Ranks ---------------------------------------------------------------------------------------


def bitmap_index(rows: DataFrame) -> DataFrame:
    """group_key, word, bits, extra, before, group_size: the ids of each group as words of a bitmap.

    Only words that hold an id are kept. `before` is the popcount directory: the rows of the group in
    earlier words, summed inside stretches of the id range and then over stretches. `extra` maps the ids
    of a word that occur several times to the number of rows besides the first.
    """
    word = F.shiftright("id", WORD_BITS)
    bit = F.expr("shiftleft(1L, cast(id & 63 as int))")
    words = cut(
        rows.groupBy("group_key", word.alias("word")).agg(
            F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("n")
        )
    )
    none = F.expr("cast(array() as array<struct<id:bigint,more:bigint>>)")
    if words.filter("n > bit_count(bits)").isEmpty():
        words = words.withColumn("extra", none)
    else:
        several = (
            rows.groupBy("group_key", "id")
            .agg((F.count(F.lit(1)) - 1).alias("more"))
            .filter("more > 0")
            .groupBy(F.col("group_key").alias("g"), word.alias("w"))
            .agg(F.collect_list(F.struct("id", "more")).alias("extra"))
        )
        same = F.col("group_key").eqNullSafe(F.col("g")) & (F.col("word") == F.col("w"))
        words = (
            words.join(several, same, "left")
            .drop("g", "w")
            .withColumn("extra", F.coalesce("extra", none))
        )
    words = words.withColumn("stretch", F.shiftright("word", STRETCH_BITS - WORD_BITS))
    stretches = words.groupBy("group_key", "stretch").agg(F.sum("n").alias("rows"))
    placed = number(stretches, ["group_key"], [F.col("stretch")], totals={"until": "rows"})
    sizes = stretches.groupBy("group_key").agg(F.sum("rows").alias("group_size"))
    placed = spread_join(placed, sizes, ["group_key"], F.col("stretch")).select(
        F.col("group_key").alias("g"),
        F.col("stretch").alias("s"),
        (F.col("until") - F.col("rows")).alias("start"),
        "group_size",
    )
    same = F.col("group_key").eqNullSafe(F.col("g")) & (F.col("stretch") == F.col("s"))
    earlier = Window.partitionBy("group_key", "stretch").orderBy("word")
    inside = F.sum("n").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    return (
        words.withColumn("inside", F.coalesce(inside, F.lit(0)))
        .join(placed, same)
        .select(
            "group_key",
            "word",
            "bits",
            "extra",
            (F.col("start") + F.col("inside")).alias("before"),
            "group_size",
        )
    )


def ranked(rows: DataFrame) -> DataFrame:
    """rows (group_key, id, leaf, …) with idx, their place in the group by (id, leaf) from 0, and
    group_size. Ids are unique as a rule; rows of a repeated id are numbered apart."""
    index = bitmap_index(rows)
    named = index.select(
        F.col("group_key").alias("g"), F.col("word").alias("w"), "bits", "extra", "before", "group_size"
    )
    same = F.col("group_key").eqNullSafe(F.col("g")) & (
        F.shiftright("id", WORD_BITS) == F.col("w")
    )
    lower = F.expr("bit_count(bits & ~shiftleft(-1L, cast(id & 63 as int)))").cast("long")
    more = F.expr(
        "aggregate(filter(extra, e -> e.id < id), 0L, (n, e) -> n + e.more)"
    )
    placed = rows.join(named, same).withColumns(
        {
            "idx": F.col("before") + lower + more,
            "again": F.expr("exists(extra, e -> e.id = id)"),
        }
    ).drop("g", "w", "bits", "extra", "before")
    placed = cut(placed)
    if placed.filter("again").isEmpty():
        return placed.drop("again")
    ties = number(
        placed.filter("again"), ["group_key", "id"], [F.col("no_id").desc(), F.col("leaf")], "tie"
    )
    return placed.filter("not again").drop("again").unionByName(
        ties.withColumn("idx", F.col("idx") + F.col("tie") - 1).drop("again", "tie")
    )


# Levels --------------------------------------------------------------------------------------


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(slots: list[str], size: int) -> list[list[str]]:
    """The levels above a block's leaves: LEVELS of them where the group has more blocks, else until
    one node remains."""
    levels = [slots]
    while (len(levels) <= LEVELS) if size > BLOCK else (len(levels[-1]) > 1):
        below = levels[-1]
        levels.append([_h(*below[k : k + FAN]) for k in range(0, len(below), FAN)])
    return levels


def _slots(table: pa.Table) -> tuple[list[int], list[str]]:
    """Places in the block by row, and the digests by place."""
    places = [i % BLOCK for i in table["idx"].to_pylist()]
    slots = [""] * len(places)
    for place, digest in zip(places, table["digest"].to_pylist(), strict=True):
        slots[place] = digest
    return places, slots


def _ways(levels: list[list[str]], above: str) -> list[str]:
    """Per leaf its siblings level by level, left and right of `|`, each level ended by `/`."""
    ways = [above]
    for nodes in reversed(levels[:-1]):
        up = ways
        ways = []
        for k in range(0, len(nodes), FAN):
            run = nodes[k : k + FAN]
            for j in range(len(run)):
                ways.append(f"{''.join(run[:j])}|{''.join(run[j + 1 :])}/{up[k // FAN]}")
    return ways


def fold(digest: str, way: str) -> str:
    """The root that a leaf and the way from it to the top give."""
    for level in way.split("/")[:-1]:
        left, right = level.split("|")
        digest = _h(left, digest, right)
    return digest


def proof(way: str) -> str:
    """SHA-256 over all siblings of a way."""
    return _h(way.replace("|", "").replace("/", ""))


def _reduce(table: pa.Table) -> pa.Table:
    size = table["group_size"][0].as_py()
    _, slots = _slots(table)
    top = _levels(slots, size)[-1][0]
    return pa.table(
        {
            "group_no": table["group_no"][:1],
            "idx": pa.array([table["idx"][0].as_py() // BLOCK]),
            "digest": [top],
            "group_size": pa.array([-(-size // BLOCK)]),
        }
    )


def climb(nodes: DataFrame) -> DataFrame:
    """The tops of the blocks of nodes (group_no, idx, digest, group_size): the same columns."""
    return (
        nodes.select("group_no", "idx", "digest", "group_size")
        .groupBy("group_no", F.expr(f"idx div {BLOCK}").alias("block"))
        .applyInArrow(_reduce, "group_no long, idx long, digest string, group_size long")
    )


def _descend(key: tuple, nodes: pa.Table, tops: pa.Table) -> pa.Table:
    places, slots = _slots(nodes)
    ways = _ways(_levels(slots, nodes["group_size"][0].as_py()), tops["way"][0].as_py())
    return nodes.append_column("way", pa.array([ways[p] for p in places]))


def _prove(key: tuple, nodes: pa.Table, tops: pa.Table) -> pa.Table:
    places, slots = _slots(nodes)
    above = tops["way"][0].as_py()
    ways = _ways(_levels(slots, nodes["group_size"][0].as_py()), above)
    folded, proofs = [], []
    for place, changed in zip(places, nodes["changed"].to_pylist(), strict=True):
        folded.append(fold(changed, ways[place]))
        proofs.append(proof(ways[place]))
    out = nodes.append_column("proof_sha256", pa.array(proofs))
    return out.append_column("folded_root", pa.array(folded))


def _beside(nodes: DataFrame, tops: DataFrame, run, schema: str) -> DataFrame:
    block = F.expr(f"idx div {BLOCK}").alias("block")
    return (
        nodes.groupBy("group_no", block)
        .cogroup(tops.groupBy("group_no", F.col("idx").alias("block")))
        .applyInArrow(run, schema)
    )


_NODE = "group_no long, idx long, digest string, group_size long"


def _tree(leaves: DataFrame) -> list[DataFrame]:
    """leaves and the tops of their blocks, and of theirs, up to one node per group."""
    layers = [leaves]
    while not layers or layers[-1].filter("group_size > 1").limit(1).count():
        layers.append(cut(climb(layers[-1])))
    if len(layers) == 1:
        # Groups of one leaf each: the leaf is the top.
        layers.append(cut(climb(leaves)))
    return layers


def manifest(
    docs: DataFrame,
    fields: list[str],
    id_col: str = "doc_id",
    group_col: str = "lang",
    changes: dict[str, Column] | None = None,
    suspect: Column | None = None,
) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the SHA-256 of the fields. Per value of group_col the leaves in the order of id_col (an
    integer), null first, form a tree of FAN children a node, whose top is the subroot; subroots ordered
    by group, null first, form the tree to the root. The proof is the hash of the siblings from the leaf to
    the root. `changes` replaces columns where `suspect` is true (null: false), and folded_root is what the leaf of
    the result, with the recorded siblings, leads to; it is the root where nothing was changed, and
    verified says so.

    Places are ranks in bitmaps of the ids (bitmap_index), found by an equi-join on the word, without
    sorting the leaves. Blocks of BLOCK leaves, put into slot arrays by their place, are reduced LEVELS
    levels at a time; on the way down each block gets the siblings above it as one text.

    Defined cases: null ids come before all others and share a place with the smallest number that
    there is, before it. Rows with the same id are ordered by their leaf (equal leaves in any order).
    A null group is a group. Null fields enter as `-`. An empty table gives no rows. Other columns
    are ignored, whatever their names.
    """
    changes = changes or {}
    changed = [changes.get(c, F.col(c)) for c in fields]
    group = F.col(group_col).cast("string").alias("group_key")
    smallest = F.lit(-(1 << 63)).cast("long")
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            group,
            F.coalesce(F.col(id_col).cast("long"), smallest).alias("id"),
            F.col(id_col).isNull().alias("no_id"),
            leaf(*[F.col(c) for c in fields]).alias("leaf"),
            (leaf(*changed) if suspect is None else F.when(suspect, leaf(*changed))).alias("changed"),
        ).withColumn("changed", F.coalesce("changed", "leaf"))
    )
    groups = cut(
        number(
            rows.select("group_key").distinct(), [], [F.col("group_key").asc_nulls_first()], "group_no"
        )
    )
    placed = spread_join(ranked(rows), groups, ["group_key"], F.col("id")).select(
        "doc_id", "group_no", "idx", F.col("leaf").alias("digest"), "changed", "group_size"
    )
    placed = cut(placed.drop("group_key"))
    layers = _tree(placed)
    subroots = layers[-1].select("group_no", "digest")
    n_groups = groups.count()
    heads = subroots.select(
        F.lit(0).cast("long").alias("group_no"),
        (F.col("group_no") - 1).alias("idx"),
        "digest",
        F.lit(n_groups).cast("long").alias("group_size"),
    )
    forest = _tree(heads)
    above = forest[-1].withColumn("way", F.lit(""))
    for nodes in reversed(forest[:-1]):
        above = _beside(nodes, above, _descend, f"{_NODE}, way string")
    above = cut(
        above.select(
            (F.col("idx") + 1).alias("group_no"), F.lit(0).cast("long").alias("idx"), "way"
        )
    )
    for nodes in reversed(layers[1:-1]):
        above = _beside(nodes, above, _descend, f"{_NODE}, way string")
    schema = (
        f"doc_id {docs.schema[id_col].dataType.simpleString()}, group_no long, idx long,"
        " digest string, changed string, group_size long, proof_sha256 string, folded_root string"
    )
    proved = _beside(placed, above, _prove, schema)
    root = forest[-1].select(F.col("digest").alias("root"))
    named = subroots.withColumnRenamed("digest", "subroot").crossJoin(F.broadcast(root))
    return spread_join(proved, named, ["group_no"], F.col("idx")).select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
