"""Near-duplicate vectors by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightmatch.llm.components import components, least_labels
from sightmatch.sources.scratch import cut

#: Leading principal dimensions of the grid, vectors they are fitted on, bytes of a block.
DIMS, FIT_ROWS, BLOCK_BYTES = 8, 4_096, 256 << 10
#: Intervals that are joined into one of the next level: 1 << FAN_BITS.
FAN_BITS = 2


def _principal(vectors: DataFrame) -> np.ndarray | None:
    """Orthonormal leading directions of the most frequent length, from at most FIT_ROWS vectors
    by a hash of the id. Right for any basis, they only make skipping effective."""
    common = vectors.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if common is None:
        return None
    rows = (
        vectors.filter(F.col("size") == common["size"])
        .orderBy(F.xxhash64("vec_id"), "vec_id")
        .limit(FIT_ROWS)
        .select("embedding")
        .toArrow()
    )
    x = _unit(np.array(rows["embedding"].to_pylist(), np.float64))
    _, _, directions = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    return directions[:DIMS].T.copy()


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _project(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """DIMS coordinates that never lie further apart than the vectors."""
    at = x @ basis if x.shape[1] == len(basis) else x[:, :DIMS]
    return np.pad(at, ((0, 0), (0, DIMS - at.shape[1])))


def _blocks(vectors: DataFrame, basis: np.ndarray, epsilon: float) -> DataFrame:
    """Vectors in grid order, cut into blocks: label, size, part, nth (place in the sequence), ids,
    copies, packed vectors, and the box (lo, hi) around their coordinates."""
    element = np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64
    cells = ", ".join(f"c{i} int" for i in range(DIMS))
    picked = vectors.select("label", "size", "vec_id", "copies", "embedding")
    label, id_type = (vectors.schema[c].dataType.simpleString() for c in ("label", "vec_id"))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy(zero_copy_only=False)
            flat = batch.column(4).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            grid = np.zeros((len(sizes), DIMS), np.int32)
            packed: list[bytes] = [b""] * len(sizes)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = flat[(ends[rows] - size)[:, None] + np.arange(size)]
                grid[rows] = np.floor(_project(_unit(x.astype(np.float64)), basis) / epsilon)
                for r, v in zip(rows, x.astype(element), strict=True):
                    packed[r] = v.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(packed, pa.binary()), *(pa.array(c) for c in grid.T)],
                ["label", "size", "vec_id", "copies", "v", *(f"c{i}" for i in range(DIMS))],
            )

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, schema = TaskContext.get().partitionId(), 0, None
        held: list[tuple] = []

        def block():
            size = held[0][1]
            x = np.frombuffer(b"".join(r[4] for r in held), element).reshape(len(held), size)
            at = _project(_unit(x.astype(np.float64)), basis)
            return {
                "label": held[0][0],
                "size": size,
                "part": part,
                "nth": nth,
                "ids": [r[2] for r in held],
                "copies": [r[3] for r in held],
                "packed": x.tobytes(),
                "lo": at.min(axis=0).tolist(),
                "hi": at.max(axis=0).tolist(),
            }

        for batch in batches:
            schema = _block_schema(batch.schema.types[0], batch.schema.types[2])
            for row in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
                full = held and (len(held) + 1) * row[1] * element().itemsize > BLOCK_BYTES
                if held and (full or row[:2] != held[0][:2]):
                    yield pa.RecordBatch.from_pylist([block()], schema)
                    nth, held = nth + 1, []
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist([block()], schema)

    placed = picked.mapInArrow(
        place, f"label {label}, size int, vec_id {id_type}, copies long, v binary, {cells}"
    )
    order = ["label", "size", *(f"c{i}" for i in range(DIMS)), "vec_id"]
    return placed.orderBy(*order).mapInArrow(
        gather,
        f"label {label}, size int, part long, nth long, ids array<{id_type}>, "
        "copies array<long>, packed binary, lo array<double>, hi array<double>",
    )


def _block_schema(label: pa.DataType, ids: pa.DataType) -> pa.Schema:
    return pa.schema(
        [
            ("label", label),
            ("size", pa.int32()),
            ("part", pa.int64()),
            ("nth", pa.int64()),
            ("ids", pa.list_(ids)),
            ("copies", pa.list_(pa.int64())),
            ("packed", pa.binary()),
            ("lo", pa.list_(pa.float64())),
            ("hi", pa.list_(pa.float64())),
        ]
    )


def _near(a: str, b: str, epsilon: float):
    """Whether two boxes come within epsilon of each other."""
    gaps = (
        F.greatest(F.lit(0.0), F.col(f"{b}.lo{i}") - F.col(f"{a}.hi{i}"), F.col(f"{a}.lo{i}") - F.col(f"{b}.hi{i}"))
        for i in range(DIMS)
    )
    return sum((g * g for g in gaps), F.lit(0.0)) <= epsilon * epsilon + 1e-9


def _block_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """label, size, a, b (a <= b): places of the blocks that may hold linked vectors.

    Recursion over the sequence: a pair of intervals that come within epsilon is replaced by the
    pairs of their parts, from the whole sequence down to single blocks."""
    top = blocks.agg(F.max("part").alias("part"), F.max("nth").alias("nth")).first()
    bits = max(1, int(top["nth"]).bit_length())
    levels = -(-(bits + int(top["part"]).bit_length()) // FAN_BITS)
    boxes = [F.col("lo")[i].alias(f"lo{i}") for i in range(DIMS)]
    boxes += [F.col("hi")[i].alias(f"hi{i}") for i in range(DIMS)]
    leaf = blocks.select("label", "size", (F.shiftleft("part", bits) + F.col("nth")).alias("at"), *boxes)
    outer = [F.min(f"lo{i}").alias(f"lo{i}") for i in range(DIMS)]
    outer += [F.max(f"hi{i}").alias(f"hi{i}") for i in range(DIMS)]
    nodes = [cut(leaf)]
    for _ in range(levels):
        up = F.shiftright("at", FAN_BITS).alias("at")
        nodes.append(cut(nodes[-1].groupBy("label", "size", up).agg(*outer)))
    pairs = nodes[-1].select("label", "size", F.col("at").alias("a"), F.col("at").alias("b"))
    for level in reversed(nodes[:-1]):
        a = level.withColumn("a", F.shiftright("at", FAN_BITS)).alias("x")
        b = level.withColumn("b", F.shiftright("at", FAN_BITS)).alias("y")
        pairs = cut(
            pairs.join(a, ["label", "size", "a"])
            .join(b, ["label", "size", "b"])
            .filter(F.col("x.at") <= F.col("y.at"))
            .filter(_near("x", "y", epsilon))
            .select("label", "size", F.col("x.at").alias("a"), F.col("y.at").alias("b"))
        )
    return pairs.withColumn("bits", F.lit(bits))


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors of one label are linked when their cosine (double precision) is at least `threshold`.
    n_links counts other rows linked directly, component_id is the smallest id reachable, kept
    says that it is the row's own. On the unit sphere this is a join within
    epsilon = sqrt(2 - 2 * threshold): vectors are sorted by the grid cells (of width epsilon) of
    their leading principal coordinates, the sequence is cut into blocks, and intervals of it are
    joined recursively, skipping those whose boxes are further apart than epsilon. Blocks left are
    compared by a matrix product in one task, which returns counts and component representatives, at
    most one row per vector, never pairs. Equal vectors are one beforehand.

    Defined cases: ids and labels may be of any type with an order, texts included. Vectors that are null, empty, zero or hold null or non-finite components, and
    those without label or id, are linked with nothing; without an id component_id is null and
    kept true. Vectors of unequal lengths are not linked. Rows with the same id and vector count as
    two rows, linked with each other. An empty table gives no rows. Other columns are ignored,
    whatever their names."""
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    rows = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label")
    )
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    )
    classes = cut(
        rows.filter(usable)
        .groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
        .withColumn("size", F.size("embedding"))
    )
    basis = _principal(classes)
    if basis is None:
        return rows.select(
            "vec_id",
            F.lit(0).cast("long").alias("n_links"),
            F.col("vec_id").alias("component_id"),
            F.lit(True).alias("kept"),
        )
    blocks = cut(_blocks(classes, basis, epsilon))
    pairs = _block_pairs(blocks, epsilon)
    at = F.shiftleft("part", pairs.select("bits").first()["bits"]) + F.col("nth")
    own = blocks.select("label", "size", at.alias("at"), "ids", "copies", "packed")
    side = lambda s: own.select(
        "label", "size", F.col("at").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("ids", "copies", "packed"))
    )
    met = pairs.join(side("a"), ["label", "size", "a"]).join(side("b"), ["label", "size", "b"])
    id_type = rows.schema["vec_id"].dataType.simpleString()
    wide = rows.schema["embedding"].dataType.elementType.typeName() != "float"
    element = np.float64 if wide else np.float32

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                size, same = row["size"].as_py(), row["a"] == row["b"]
                x, y = (
                    _unit(np.frombuffer(row[c].as_buffer(), element).reshape(-1, size).astype(np.float64))
                    for c in ("packed_a", "packed_b")
                )
                hits = x @ y.T >= threshold
                if same:
                    np.fill_diagonal(hits, False)
                if not hits.any():
                    continue
                ids = [np.asarray(row[c].values) for c in ("ids_a", "ids_b")]
                weight = [np.asarray(row[c].values) for c in ("copies_a", "copies_b")]
                n = np.concatenate([hits @ weight[1], np.zeros(len(y), int) if same else hits.T @ weight[0]])
                both, least = np.concatenate(ids), least_labels(hits, same)
                kind = row["ids_a"].type.value_type
                used = np.flatnonzero(n > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(both[used], kind),
                        pa.array(both[least[used]], kind),
                        pa.array(n[used].astype(np.int64)),
                    ],
                    ["vec_id", "other", "n"],
                )

    columns = ["size", "a", "b", "ids_a", "copies_a", "packed_a", "ids_b", "copies_b", "packed_b"]
    found = cut(met.select(columns).mapInArrow(compare, f"vec_id {id_type}, other {id_type}, n long"))
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    reached = components(found, "vec_id", "other").withColumnRenamed("node", "vec_id")
    known = (
        classes.join(counts, "vec_id", "left")
        .join(reached, "vec_id", "left")
        .select(
            F.col("label").alias("l"),
            F.col("embedding").alias("e"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        )
    )
    same = (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")) & F.col("vec_id").isNotNull()
    component = F.coalesce("component_id", "vec_id")
    return rows.join(known, same, "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
