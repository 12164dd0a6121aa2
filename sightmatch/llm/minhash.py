"""Near duplicates of texts by MinHash with tensored banding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightmatch.llm.batches import free_names, small_batches
from sightmatch.llm.components import components, least_labels
from sightmatch.llm.shingles import byte_slices, mix, shingle_sets
from sightmatch.sources.scratch import cut

#: Bytes of text that are hashed at once; ids that may be broadcast to pick rows by.
SLICE_BYTES, BROADCAST_IDS = 1 << 20, 1_000_000
#: Documents and bytes of sets in a block, columns of an incidence matrix at a time.
BLOCK_DOCS, BLOCK_BYTES, COLUMNS = 512, 2 << 20, 2_048
#: Pairs with one document that share a task.
SHARE_PAIRS = 200


def _half_keys(sets: list[np.ndarray], rows: int, halves: int) -> np.ndarray:
    """2 * halves keys per set, each of `rows` minima. Empty sets get zeros."""
    out = np.zeros((len(sets), 2 * halves), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    values = np.concatenate([sets[i] for i in full])
    starts = np.cumsum([0] + [len(sets[i]) for i in full])[:-1]
    factors = mix(np.arange(1, 2 * halves * rows + 1, dtype=np.uint64)) | np.uint64(1)
    for h in range(2 * halves):
        key = np.zeros(len(full), np.uint64)
        for r in range(rows):
            least = np.minimum.reduceat((values * factors[h * rows + r]) >> np.uint64(32), starts)
            key = mix(key * np.uint64(0x100000001B3) + least)
        out[full, h] = key
    return out


def _signatures(docs: DataFrame, words: int, rows: int, halves: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, left and right half keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in byte_slices(batch.column(1), SLICE_BYTES):
                sets = shingle_sets(texts, words)
                keys = _half_keys(sets, rows, halves).view(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(start, len(texts)),
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "digest": pa.array([hashlib.sha256(s.tobytes()).digest() for s in sets]),
                        "left": pa.array(list(keys[:, :halves]), pa.list_(pa.int64())),
                        "right": pa.array(list(keys[:, halves:]), pa.list_(pa.int64())),
                    }
                )

    return docs.mapInArrow(
        run,
        f"doc_id {kind}, n_shingles long, digest binary, left array<long>, right array<long>",
    )


def _sets(docs: DataFrame, met: DataFrame, words: int, classes: DataFrame | None) -> DataFrame:
    """doc, shingles (array) of the classes in met (doc). These are ids, or, where ids have several
    texts, numbers of `classes`: texts are then picked by id and their sets by digest."""
    kind, by_digest = docs.schema["doc_id"].dataType.simpleString(), classes is not None
    ids = met.select(F.col("doc").alias("doc_id"))
    if by_digest:
        wanted = cut(classes.join(met, "doc", "left_semi").select("doc", "doc_id", "digest"))
        ids = wanted.select("doc_id").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in byte_slices(batch.column(1), SLICE_BYTES):
                sets = [s.view(np.int64) for s in shingle_sets(texts, words)]
                name = batch.column(0).slice(start, len(texts))
                if by_digest:
                    name = pa.array([hashlib.sha256(s.tobytes()).digest() for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [name, pa.array(sets, pa.list_(pa.int64()))], ["name", "shingles"]
                )

    picked = docs.join(ids, "doc_id", "left_semi")
    if not by_digest:
        found = picked.mapInArrow(run, f"name {kind}, shingles array<long>")
        return found.withColumnRenamed("name", "doc").dropDuplicates(["doc"])
    found = picked.mapInArrow(run, "name binary, shingles array<long>")
    found = found.withColumnRenamed("name", "digest")
    return (
        found.dropDuplicates(["digest"])
        .join(wanted.select("digest", "doc"), "digest")
        .select("doc", "shingles")
    )


def _of_one_id(linkable: DataFrame, several: DataFrame, classes: DataFrame) -> DataFrame:
    """Links x, y between the classes that rows of one id are in, for the ids in several."""
    numbers = classes.select("digest", "doc")
    own = (
        linkable.join(several, "doc_id", "left_semi")
        .select("doc_id", "digest").distinct()
        .join(numbers, "digest")
    )
    heads = own.groupBy("doc_id").agg(F.min("doc").alias("y"))
    return own.join(heads, "doc_id").select(F.col("doc").alias("x"), "y").filter("x != y")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs x, y that are linked. The y of an x are dealt out in shares; the set of x comes
    first in each, then those of its y are compared with it as they stream by."""
    share, whole = threshold
    kind = pairs.schema["x"].dataType.simpleString()
    sizes = pairs.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / SHARE_PAIRS).cast("int").alias("n"))
    own = sets.withColumnRenamed("doc", "x")
    nothing = F.lit(None).cast(kind)
    first = (
        sizes.join(own, "x")
        .withColumn("share", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("x", "share", nothing.alias("y"), "shingles")
    )
    then = (
        pairs.join(sizes, "x")
        .select("x", F.pmod(F.xxhash64("y"), F.col("n")).cast("int").alias("share"), "y")
        .join(sets.withColumnRenamed("doc", "y"), "y")
        .select("x", "share", "y", "shingles")
    )

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = None, np.zeros(0, np.int64)
        for batch in batches:
            lists = batch.column(3)
            flat = np.asarray(lists.flatten())
            ends = np.cumsum(np.asarray(lists.value_lengths())).tolist()
            xs, ys, start = [], [], 0
            keys = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), ends, strict=True)
            for x, y, end in keys:
                values, start = flat[start:end], end
                if y is None:
                    head, held = x, values
                elif x == head:
                    common = len(np.intersect1d(held, values, assume_unique=True))
                    if common * whole >= (len(held) + len(values) - common) * share:
                        xs.append(x)
                        ys.append(y)
            types = batch.schema.types
            yield pa.RecordBatch.from_arrays(
                [pa.array(xs, types[0]), pa.array(ys, types[2])], ["x", "y"]
            )

    return (
        first.unionAll(then)
        .repartition("x", "share")
        .sortWithinPartitions("x", "share", F.col("y").asc_nulls_first())
        .mapInArrow(compare, f"x {kind}, y {kind}")
    )


def _links_in_groups(apart: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links x, y that join the components of linked documents among those of `apart`
    (pivot, doc, of_doc: component so far) that buckets connect.

    Documents of a connected group are sorted by the size of their sets and cut into blocks. Two
    blocks are compared in one task by products of their incidence matrices, unless their sizes or a
    common component rule links out or make them needless; no pairs of documents leave a task."""
    share, whole = threshold
    grouped = components(apart, "pivot", "doc").withColumnRenamed("node", "doc")
    docs = (
        apart.select("doc", "of_doc").distinct()
        .join(grouped, "doc", "left")
        .select("doc", "of_doc", F.coalesce("component", "doc").alias("group"))
        .join(sets, "doc")
        .select("group", F.size("shingles").alias("n"), "doc", "of_doc", "shingles")
    )
    kind = apart.schema["doc"].dataType.simpleString()

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def block():
            group, n, docs, of_doc, shingles = zip(*held, strict=True)
            same = of_doc[0] if len(set(of_doc)) == 1 else None
            values = {
                "group": pa.array(group[:1], types[0]),
                "at": pa.array([number], pa.int64()),
                "low": pa.array([n[0]], pa.int64()),
                "high": pa.array([n[-1]], pa.int64()),
                "same": pa.array([same], types[3]),
                "docs": pa.array([docs], pa.list_(types[2])),
                "sizes": pa.array([n], pa.list_(pa.int64())),
                "packed": pa.array([b"".join(shingles)], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(values)

        for batch in batches:
            types = batch.schema.types
            lists = batch.column(4)
            flat = np.asarray(lists.flatten())
            ends = np.cumsum(np.asarray(lists.value_lengths()))
            rows = zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)
            for i, row in enumerate(rows):
                if held and (row[0] != held[0][0] or len(held) == BLOCK_DOCS or size > BLOCK_BYTES):
                    yield block()
                    number, held, size = number + 1, [], 0
                own = np.sort(flat[ends[i] - row[1] : ends[i]].view(np.uint64)).tobytes()
                held.append((*row, own))
                size += len(own)
        if held:
            yield block()

    blocks = cut(
        docs.orderBy("group", "n", "doc").mapInArrow(
            gather,
            f"group {kind}, at long, low long, high long, same {kind}, docs array<{kind}>, "
            "sizes array<long>, packed binary",
        )
    )
    # Pairs of blocks are made without their contents and dealt over the tasks, however many of them
    # one group has; the contents then come by the blocks' numbers.
    heads = blocks.select("group", "at", "low", "high", "same")
    a, b = heads.alias("a"), heads.alias("b")
    pairs = (
        a.join(b, F.col("a.group") == F.col("b.group"))
        .filter("a.at <= b.at")
        .filter(F.expr(f"a.high * {whole}L >= b.low * {share}L"))
        .filter("a.same IS NULL OR b.same IS NULL OR a.same != b.same")
        .select(F.col("a.at").alias("at_a"), F.col("b.at").alias("at_b"))
        .repartition("at_a", "at_b")
    )
    contents = [
        blocks.select(*(F.col(c).alias(f"{c}_{side}") for c in ("at", "docs", "sizes", "packed")))
        for side in "ab"
    ]
    met = (
        pairs.join(contents[0], "at_a")
        .join(contents[1], "at_b")
        .withColumn("own", F.col("at_a") == F.col("at_b"))
    )

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                docs, sizes, shingles = (
                    [np.asarray(row[f"{c}_{side}"].values) for side in "ab"]
                    if c != "packed"
                    else [np.frombuffer(row[f"{c}_{side}"].as_buffer(), np.uint64) for side in "ab"]
                    for c in ("docs", "sizes", "packed")
                )
                common = _common(sizes, shingles)
                total = sizes[0][:, None] + sizes[1][None, :] - common
                hits = common * whole >= total * share
                if row["own"].as_py():
                    np.fill_diagonal(hits, False)
                if not hits.any():
                    continue
                least = least_labels(hits, row["own"].as_py())
                both = np.concatenate(docs)
                used = np.flatnonzero(least != np.arange(len(least)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[used]), pa.array(both[least[used]])], ["x", "y"]
                )

    return met.mapInArrow(compare, f"x {kind}, y {kind}").filter("x != y")


def _common(sizes: list[np.ndarray], shingles: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of one block with every set of another."""
    shared = np.intersect1d(np.unique(shingles[0]), np.unique(shingles[1]))
    out = np.zeros((len(sizes[0]), len(sizes[1])))
    places = []
    for n, own in zip(sizes, shingles, strict=True):
        at = np.minimum(np.searchsorted(shared, own), max(0, len(shared) - 1))
        there = shared[at] == own if len(shared) else np.zeros(len(own), bool)
        places.append((np.repeat(np.arange(len(n)), n)[there], at[there]))
    for start in range(0, len(shared), COLUMNS):
        parts = []
        for n, (rows, at) in zip(sizes, places, strict=True):
            inside = (at >= start) & (at < start + COLUMNS)
            part = np.zeros((len(n), min(COLUMNS, len(shared) - start)), np.float32)
            part[rows[inside], at[inside] - start] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    threshold: tuple[int, int] = (80, 100),
    rows: int = 3,
    halves: int = 9,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked when intersection / union of their sets of word shingles is at least
    `threshold`; component_id is the smallest id reachable by links, kept says that it is the row's
    own. 2 * halves half keys of `rows` minima each are computed; every pair (left, right) is
    the key of a table, so halves * halves tables of 2 * rows minima come from 2 * halves * rows.
    With p = similarity ** rows, a pair shares a key with probability (1 - (1 - p) ** halves) ** 2:
    0.9996 at 0.85, 0.997 at 0.8 with the defaults.

    Equal sets are one class, which goes on as its smallest id, or as a number if some id has
    several sets, since it could then stand for several classes. In each bucket of a table all classes
    are compared with its smallest one, on full sets. The links found join most buckets into one
    component each; where members of a bucket are in different ones, the documents that such
    buckets connect are compared block by block (_links_in_groups). So no linked pair that shares a
    key is lost, and groups are never expanded into pairs of documents.

    Defined cases: null, empty and blank texts have no shingles and are linked with nothing; a text
    with fewer words is one shingle. Rows with a null id are linked with nothing, component_id
    is null and kept is true. Rows with the same id count as one document: it has the links of all their
    texts, but rows without shingles are linked with nothing. An empty table gives no rows. Other columns are ignored, whatever their names."""
    docs = small_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    signed = cut(_signatures(docs, words, rows, halves))
    linkable = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = linkable.groupBy("digest").agg(
        F.min(F.struct("doc_id", "left", "right")).alias("least")
    )
    several = linkable.groupBy("doc_id").agg(
        F.min("digest").alias("low"), F.max("digest").alias("high")
    )
    several = several.filter("low != high").select("doc_id")
    numbered = not several.isEmpty()
    if numbered:
        # The numbers stay as they are, since the classes are written once.
        number = F.monotonically_increasing_id().alias("doc")
        classes = cut(classes.select("digest", "least.*", number))
    else:
        classes = classes.select("digest", "least.*", F.col("least.doc_id").alias("doc"))
    keys = classes.select(
        "doc",
        F.explode(
            F.flatten(
                F.transform(
                    "left",
                    lambda a, i: F.transform("right", lambda b, j: F.xxhash64(i, j, a, b)),
                )
            )
        ).alias("key"),
    )
    tables = keys.groupBy("key").agg(
        F.min("doc").alias("pivot"), F.max("doc").alias("last")
    ).filter("pivot != last")
    buckets = cut(keys.join(tables.drop("last"), "key").filter("doc != pivot"))
    stars = buckets.select(F.col("pivot").alias("x"), F.col("doc").alias("y")).distinct()
    stars = cut(stars)
    met = cut(stars.select(F.explode(F.array("x", "y")).alias("doc")).distinct())
    sets = cut(_sets(docs, met, words, classes if numbered else None))
    found = components(_confirmed(stars, sets, threshold), "x", "y")

    # Buckets whose members are not all in one component yet.
    named = found.select(F.col("node").alias("doc"), F.col("component").alias("of_doc"))
    members = buckets.join(named, "doc", "left").withColumn("of_doc", F.coalesce("of_doc", "doc"))
    mixed = members.groupBy("key").agg(
        F.min("of_doc").alias("low"), F.max("of_doc").alias("high")
    ).filter("low != high")
    apart = cut(members.join(mixed.select("key"), "key", "left_semi").select("pivot", "doc", "of_doc").distinct())
    more = _links_in_groups(apart, sets, threshold)
    if numbered:
        more = more.unionAll(_of_one_id(linkable, several, classes))
    more = cut(more)
    if not more.isEmpty():
        trees = found.select(F.col("node").alias("x"), F.col("component").alias("y"))
        found = components(trees.unionAll(more), "x", "y")

    of_class = classes.select("digest", "doc", "doc_id").join(
        found.withColumnRenamed("node", "doc"), "doc", "left"
    ).select("digest", "doc_id", F.coalesce("component", "doc").alias("component"))
    if numbered:
        # Components of numbers are named by the smallest id in them.
        names = of_class.groupBy("component").agg(F.min("doc_id").alias("name"))
        of_class = of_class.join(names, "component").select("digest", F.col("name").alias("component"))
    of_class = of_class.select("digest", "component")
    labelled = signed.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(component, F.col("doc_id")))
    return labelled.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs that stay, one document of each group, with all their columns.

    Defined cases: as for near_duplicates(). The rows of one id stay or go together. Rows with a
    null id stay. An empty table gives no rows. Other columns are passed on, whatever their names."""
    (gone_id,) = free_names(docs, "gone_id")
    gone = near_duplicates(docs, id_col=id_col, **how).filter("NOT kept")
    gone = gone.select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(gone_id), "left_anti")
