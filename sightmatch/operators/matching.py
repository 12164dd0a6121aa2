"""Who does an observation look like: scoring vectors against the gallery of a search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightmatch.params import check_thresholds
from sightmatch.sources.scratch import cut

# A gallery up to this size goes to every executor as one matrix; a larger one is joined in
# blocks of about this many bytes, and so many vectors at most share a task.  Every Python worker of an
# executor holds such a matrix some four times while it takes it in, so the limit is low.
BROADCAST_BYTES = 16 * 1024 * 1024
BLOCK_BYTES = 8 * 1024 * 1024
FACES_PER_TASK = 500_000
# Bytes of the vectors that share a task, and into how many parts at most a search's blocks are dealt.
SHARE_BYTES, LANES = 16 * 1024 * 1024, 8
# Against a search's gallery above this size each distinct vector is scored once; below, that costs more than it saves.
REPEAT_BYTES = 1024 * 1024

#: Matrices sent to the executors, as broadcasts. Plans that score with them need them until they are done.
_SHIPPED: list = []

# Scores closer than this are summed again in one fixed order, so that equal targets tie.
_NEAR = 1e-9
# Vectors and targets whose products are held at once, and pairs whose products are summed again at once.
_ROWS = _COLS = 1_024
_PAIRS = 65_536

_GALLERY = ["search_id", "_size"]
# What tells the vectors of a search apart: two hashes with different seeds, 128 bits.
_VECTOR = ["_hash", "_check", *_GALLERY]


def _all_and_largest(targets: DataFrame) -> tuple[int, int, bool]:
    """Size of the matrices of all searches together, that of the largest one, and whether no search
    has several targets."""
    own = targets.groupBy("search_id").agg(
        F.sum(F.size("embedding").cast("bigint") * 8 + 64).alias("own"), F.count(F.lit(1)).alias("n")
    )
    found = own.agg(F.sum("own"), F.max("own"), F.max("n")).first()
    return found[0] or 0, found[1] or 0, (found[2] or 0) <= 1


def _with_size(rows: DataFrame) -> DataFrame:
    """Rows of a search whose vector is there and whole, with its length: only equal lengths are
    compared."""
    whole = F.forall("embedding", lambda x: x.isNotNull()) & (F.size("embedding") > 0)
    usable = F.col("search_id").isNotNull() & F.coalesce(whole, F.lit(False))
    return rows.where(usable).withColumn("_size", F.size("embedding"))


def forget_galleries() -> int:
    """Destroy every matrix sent to the executors so far, on the driver and on them, and say how many
    there were. Call it once the matches are written: frames still to be scored with them fail."""
    n = len(_SHIPPED)
    while _SHIPPED:
        _SHIPPED.pop().destroy(blocking=True)
    return n


def best_target(
    faces: DataFrame,
    targets: DataFrame,
    *,
    broadcast: bool | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The most similar target of its search for each face; ties go to the lowest target_ord.

    faces(search_id, source_id, frame_id, face_idx, embedding, ...),
    targets(search_id, target_id, target_ord, embedding).  Returns the face columns without
    the vector, plus target_id, target_ord, similarity.  No pair table arises, and a task holds
    the scores of some vectors and targets only.  Against all but small galleries every distinct vector
    is scored once and its faces are joined to the answer.  Where no search has several targets, a face is
    joined with its target.  Faces without a whole vector, or without a
    target whose vector is as long, give no row; a repeated face gives a row each time.  All ways
    give the same rows.
    """
    targets = _with_size(
        targets.select(
            "search_id",
            "target_id",
            F.col("target_ord").cast("bigint").alias("target_ord"),
            "embedding",
        )
    )
    largest, single = None, False
    if broadcast is None or broadcast:
        size, largest, alone = _all_and_largest(targets)
        single = alone and broadcast is None
        broadcast = broadcast or size <= BROADCAST_BYTES
    kept = [c for c in faces.columns if c != "embedding"]
    answer = [
        T.StructField("target_id", targets.schema["target_id"].dataType),
        T.StructField("target_ord", T.LongType()),
        T.StructField("similarity", T.DoubleType()),
    ]
    if single:
        faces = _with_size(faces)
        own = F.broadcast(targets) if broadcast else targets
        return _by_join(faces, own, kept, T.StructType([*[faces.schema[c] for c in kept], *answer]))
    if broadcast and largest <= REPEAT_BYTES:
        faces = _with_size(faces)
        return _by_matrix(faces, targets, kept, T.StructType([*[faces.schema[c] for c in kept], *answer]))
    # Counting and joining by the vectors themselves would normalise each of their numbers at every step.
    hashes = {"_hash": F.xxhash64("embedding"), "_check": F.xxhash64(F.lit(1), "embedding")}
    faces = faces.where("search_id IS NOT NULL AND size(embedding) > 0").withColumns(
        {"_size": F.size("embedding"), **hashes}
    )
    vectors = _with_size(faces.select(*_VECTOR, "embedding").distinct())
    found = T.StructType([*[vectors.schema[c] for c in _VECTOR], *answer])
    if broadcast:
        best = _by_matrix(vectors, targets, _VECTOR, found)
    else:
        best = _by_blocks(vectors, faces.select(*_VECTOR).distinct(), targets, found, block_bytes)
    return faces.drop("embedding").join(best, _VECTOR).select(*kept, *[f.name for f in answer])


class _Best:
    """The best target so far of each of some vectors. Targets come by target_ord."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.top = np.full(len(vectors), -np.inf)
        self.at = np.full(len(vectors), -1)

    def meet(self, matrix: np.ndarray, first: int) -> None:
        """Compare with further targets, of which the first has this position."""
        for start in range(0, len(self.vectors), _ROWS):
            part = slice(start, start + _ROWS)
            for column in range(0, len(matrix), _COLS):
                self._tile(part, matrix[column : column + _COLS], first + column)

    def _tile(self, part: slice, tile: np.ndarray, first: int) -> None:
        vectors, top, at = self.vectors[part], self.top[part], self.at[part]
        scores = vectors @ tile.T
        high = scores.max(axis=1)
        # NaN is above all numbers, as in Spark.
        open_rows = np.flatnonzero((at < 0) | ~((high < top - _NEAR) | np.isnan(top)))
        if not len(open_rows):
            return
        scores, high = scores[open_rows], high[open_rows]
        near = scores >= (high - _NEAR)[:, None]
        odd = np.flatnonzero(np.isnan(high))
        near[odd, scores[odd].argmax(axis=1)] = True
        row, column = np.nonzero(near)
        # Summed by row, so that the value does not depend on which rows were scored together.
        exact = np.concatenate(
            [
                (vectors[open_rows[row[i : i + _PAIRS]]] * tile[column[i : i + _PAIRS]]).sum(axis=1)
                for i in range(0, len(row), _PAIRS)
            ]
        )
        best = np.maximum.reduceat(exact, np.flatnonzero(np.diff(row, prepend=-1)))
        wins = np.flatnonzero((exact == best[row]) | np.isnan(exact))
        _, firsts = np.unique(row[wins], return_index=True)
        column, value = column[wins[firsts]], exact[wins[firsts]]
        old = top[open_rows]
        better = (at[open_rows] < 0) | (value > old) | (np.isnan(value) & ~np.isnan(old))
        top[open_rows[better]] = value[better]
        at[open_rows[better]] = first + column[better]


class _Gallery:
    """The targets of one search, by target_ord, and the best of them for faces."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("target_ord")
        self.ids = rows.column("target_id").combine_chunks()
        self.ords = rows.column("target_ord").combine_chunks()
        self.matrix = _matrix(rows.column("embedding").combine_chunks(), rows.num_rows)

    def answer(self, faces: pa.RecordBatch, kept: list[str], names: list[str]) -> pa.RecordBatch:
        best = _Best(_matrix(faces.column("embedding"), faces.num_rows))
        best.meet(self.matrix, 0)
        at = pa.array(best.at)
        columns = [faces.column(c) for c in kept]
        columns += [self.ids.take(at), self.ords.take(at), pa.array(best.top)]
        return pa.RecordBatch.from_arrays(columns, names=names)


def _matrix(lists: pa.Array, n: int) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1).astype(np.float64)


def key_runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) of each stretch of equal keys."""
    codes = np.zeros(batch.num_rows, np.int64)
    for key in keys:
        column = batch.column(key).dictionary_encode()
        own = column.indices.fill_null(len(column.dictionary)).to_numpy(zero_copy_only=False)
        codes = codes * (len(column.dictionary) + 1) + own
    edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        if end > start:
            part = batch.slice(start, end - start)
            yield tuple(part.column(k)[0].as_py() for k in keys), part


def _by_join(
    faces: DataFrame, targets: DataFrame, kept: list[str], found: T.StructType
) -> DataFrame:
    """Searches of one target: each face meets it in a join, so that work and memory are those of the
    faces, however many searches there are."""
    both = faces.join(targets.withColumnRenamed("embedding", "_own"), _GALLERY).select(
        *kept, "target_id", "target_ord", "_size", "embedding", "_own"
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("_size")
            for size in sizes.unique():
                part = batch.filter(pa.compute.equal(sizes, size))
                vectors, own = (_matrix(part.column(c), part.num_rows) for c in ("embedding", "_own"))
                # Summed by row, as in _Best.
                columns = [part.column(f) for f in found.names[:-1]] + [pa.array((vectors * own).sum(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, names=found.names)

    return both.mapInArrow(score, found)


def _by_matrix(
    faces: DataFrame, targets: DataFrame, kept: list[str], found: T.StructType
) -> DataFrame:
    """Gallery under the size limit: no shuffle of the faces, one product per batch and search."""
    shipped = faces.sparkSession.sparkContext.broadcast(targets.toArrow())
    _SHIPPED.append(shipped)
    galleries: dict = {}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not galleries:
            for whole in shipped.value.sort_by([(k, "ascending") for k in _GALLERY]).combine_chunks().to_batches():
                for key, rows in key_runs(whole, _GALLERY):
                    galleries[key] = _Gallery(pa.Table.from_batches([rows]))
        for batch in batches:
            order = pa.compute.sort_indices(batch, [(k, "ascending") for k in _GALLERY])
            for key, part in key_runs(batch.take(order), _GALLERY):
                if key in galleries:
                    yield galleries[key].answer(part, kept, found.names)

    return faces.mapInArrow(score, found)


def _by_blocks(
    vectors: DataFrame, known: DataFrame, targets: DataFrame, found: T.StructType, block_bytes: int
) -> DataFrame:
    """Gallery of any size, for distinct vectors; `known` are their hashes, for counting. Each search's vectors are cut into shares that fit a
    task, and its blocks of targets are dealt into a few lanes; a share and a lane meet in one sorted run, the
    vectors first, so that the targets stream by. So each target is sent once per share and each vector
    once per lane, however many blocks there are. Only where a search has several lanes its vectors'
    rows are reduced to the best."""
    row_bytes = F.col("_size").cast("bigint") * 8
    lanes = targets.groupBy(*_GALLERY).agg(
        F.least(F.ceil(F.count(F.lit(1)) * F.first(row_bytes) / block_bytes), F.lit(LANES)).cast("int").alias("_lanes")
    )
    n = F.count(F.lit(1))
    shares = known.groupBy(*_GALLERY).agg(
        F.ceil(F.greatest(n / FACES_PER_TASK, n * F.first(row_bytes) / SHARE_BYTES)).cast("int").alias("_shares")
    )
    plan = cut(lanes.join(shares, _GALLERY))
    own = lambda columns, n: F.pmod(F.xxhash64(*columns), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    nothing = lambda kind: F.lit(None).cast(kind)
    several = (plan.agg(F.max("_lanes")).first()[0] or 0) > 1
    id_type, vector_type = (df.schema[c].dataType for df, c in ((targets, "target_id"), (vectors, "embedding")))
    first = vectors.join(plan, _GALLERY).select(
        *_GALLERY,
        # The seed differs from the one behind _hash, which deals the rows of a later join.
        own([F.lit(1), "_hash"], "_shares").alias("_share"),
        every("_lanes").alias("_lane"),
        "_hash",
        "_check",
        nothing("bigint").alias("target_ord"),
        nothing(id_type).alias("target_id"),
        F.struct("embedding").alias("own"),
        nothing(targets.schema["embedding"].dataType).alias("embedding"),
        F.lit(False).alias("_target"),
    )
    then = targets.join(plan, _GALLERY).select(
        *_GALLERY,
        every("_shares").alias("_share"),
        own(["target_id", "target_ord"], "_lanes").alias("_lane"),
        nothing("bigint").alias("_hash"),
        nothing("bigint").alias("_check"),
        "target_ord",
        "target_id",
        nothing(T.StructType([T.StructField("embedding", vector_type)])).alias("own"),
        "embedding",
        F.lit(True).alias("_target"),
    )
    meeting = [*_GALLERY, "_share", "_lane"]
    runs = (
        first.unionByName(then)
        .repartition(*meeting)
        .sortWithinPartitions(*meeting, "_target", F.col("target_ord").asc_nulls_last())
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, None
        for batch in batches:
            for key, part in key_runs(batch, meeting):
                if key != at:
                    if mine is not None:
                        yield from mine.answer(found.names)
                    at, mine = key, _Share()
                is_target = part.column("_target")
                mine.hold(part.filter(pa.compute.invert(is_target)))
                seen = part.filter(is_target)
                step = max(1, block_bytes // (8 * key[1]))
                for i in range(0, seen.num_rows, step):
                    mine.meet(seen.slice(i, step))
        if mine is not None:
            yield from mine.answer(found.names)

    best = runs.mapInArrow(score, found)
    if not several:
        return best
    rank = F.struct(F.col("similarity"), -F.col("target_ord"))
    row = F.struct(*[c for c in found.names if c not in _VECTOR])
    return (
        best.groupBy(*_VECTOR)
        .agg(F.max_by(row, rank).alias("_row"))
        .select(*[F.col(c) if c in _VECTOR else F.col(f"_row.{c}").alias(c) for c in found.names])
    )


class _Share:
    """The vectors that share a task, and the best targets of those that have come by."""

    def __init__(self):
        self.held: list[pa.RecordBatch] = []
        self.best: _Best | None = None

    def hold(self, rows: pa.RecordBatch) -> None:
        if rows.num_rows:
            self.held.append(rows)

    def meet(self, targets: pa.RecordBatch) -> None:
        if not self.held:
            return
        if self.best is None:
            self.rows = pa.Table.from_batches(self.held).combine_chunks().to_batches()[0]
            own = self.rows.column("own").flatten()[0]
            self.best = _Best(_matrix(own, self.rows.num_rows))
            kinds = (targets.schema.field(c).type for c in ("target_id", "target_ord"))
            self.told = [pa.nulls(self.rows.num_rows, kind) for kind in kinds]
        n = self.rows.num_rows
        # Positions below n stand for what was best before.
        self.best.meet(_matrix(targets.column("embedding"), targets.num_rows), n)
        new = self.best.at >= n
        if new.any():
            place = pa.array(np.where(new, self.best.at, np.arange(n)))
            self.told = [
                pa.concat_arrays([old, targets.column(c)]).take(place)
                for old, c in zip(self.told, ("target_id", "target_ord"), strict=True)
            ]
            self.best.at[new] = 0

    def answer(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        if self.best is None:
            return
        rows = self.rows
        columns = [rows.column(c) for c in _VECTOR]
        columns += [*self.told, pa.array(self.best.top)]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def match_gallery(
    faces: DataFrame,
    targets: DataFrame,
    threshold: float,
    *,
    broadcast: bool | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Accepted faces with their best target, if that target is still active and similar enough.

    All targets of the search compete, found ones too: a face whose best match is already
    found is dropped, not given to the next one.  `accepted` and `active` may be absent.
    """
    if "accepted" in faces.columns:
        faces = faces.where("accepted")
    best = best_target(faces, targets, broadcast=broadcast, block_bytes=block_bytes)
    best = best.where(F.col("similarity") >= threshold)
    if "active" not in targets.columns:
        return best
    active = targets.where("active").select("search_id", "target_id")
    return best.join(active, ["search_id", "target_id"], "left_semi")


def match_target(
    faces: DataFrame, targets: DataFrame, *, broadcast: bool | None = None
) -> DataFrame:
    """Every accepted face against the one target of its search, whatever the similarity.

    A face below the threshold is no evidence but still updates what was seen last.
    """
    if "accepted" in faces.columns:
        faces = faces.where("accepted")
    return best_target(faces, targets, broadcast=broadcast)


def sweep(observations: DataFrame, thresholds) -> DataFrame:
    """The same observations once per threshold; nothing is scored again."""
    values = check_thresholds(thresholds)
    return observations.withColumn(
        "threshold", F.explode(F.array(*[F.lit(value) for value in values]))
    )
