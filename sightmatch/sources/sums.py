"""SHA-256 of files of any length, a bounded part of each in a task."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightmatch.sources.scratch import fresh_path

#: Bytes of a row in between, and of a state of the sum as OpenSSL keeps it (plain numbers, no addresses).
PIECE_BYTES, STATE_BYTES = 1 << 20, 112
# Spark's reader of lines leaves this out where a file begins with it.
_MARK = b"\xef\xbb\xbf"


class Sha256:
    """A SHA-256 whose state can go to another task; hashlib's stays in its process."""

    def __init__(self, state: bytes | None = None):
        import _hashlib

        self._lib = ctypes.CDLL(_hashlib.__file__)
        self._own = ctypes.create_string_buffer(state or b"", 256)
        if state is None:
            self._lib.SHA256_Init(self._own)

    def update(self, data: bytes) -> None:
        self._lib.SHA256_Update(self._own, data, ctypes.c_size_t(len(data)))

    @property
    def state(self) -> bytes:
        return self._own.raw[:STATE_BYTES]

    def hexdigest(self) -> str:
        out, rest = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self._own.raw, 256)
        self._lib.SHA256_Final(out, rest)
        return out.raw.hex()


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.Array]]:
    """((file, size, start), lines) of each stretch of one split's lines."""
    file = batch.column("file").dictionary_encode().indices.to_numpy()
    new = np.diff(file).astype(bool) | np.diff(batch.column("start").to_numpy()).astype(bool)
    edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
    for begin, end in zip(edges[:-1], edges[1:], strict=True):
        if end > begin:
            key = tuple(batch.column(c)[begin].as_py() for c in ("file", "size", "start"))
            yield key, batch.column("data").slice(begin, end - begin)


def _pieces(spark: SparkSession, paths: list[str], step_bytes: int) -> str:
    """The files' bytes as rows (file, size, start, nth, data) in a folder per step of each file; `start` is that
    of the split.  A line but the first of a file has its separator before it; what ends the file is not
    among them."""
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("data"),
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nth, held, size = None, 0, [], 0

        def piece() -> pa.RecordBatch:
            row = [[at[0]], [at[1]], [at[2]], [nth], [b"".join(held)]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(row, kinds, strict=True)],
                ["file", "size", "start", "nth", "data"],
            )

        for batch in batches:
            for key, lines in _runs(batch):
                if key != at or size >= PIECE_BYTES:
                    if held:
                        yield piece()
                    at, nth, held, size = key, nth + 1 if key == at else 0, [], 0
                if held or nth or key[2]:
                    held.append(b"\n")
                held.append(b"\n".join(lines.to_pylist()))
                size += len(held[-1]) + 1
        if held:
            yield piece()

    path = fresh_path(spark, "pieces")
    pieces = lines.mapInArrow(join, "file STRING, size BIGINT, start BIGINT, nth BIGINT, data BINARY")
    step = F.floor(F.col("start") / F.lit(step_bytes)).cast("bigint")
    pieces.withColumn("step", step).write.option("compression", "none").partitionBy("step").parquet(path)
    return path


def sums_in_steps(spark: SparkSession, paths: list[str], step_bytes: int) -> list[tuple[str, int, str]]:
    """(file, length, sha256) of files, which Spark's reader of lines does not take for compressed.

    The sum is a chain through a file's bytes.  Their splits are read in parallel and written as pieces once;
    then a job per step takes the next `step_bytes` of all files at once, a file's by one task, from the
    state that the one before left.  No task reads more than a step and a split; a line is held whole."""
    path = _pieces(spark, paths, step_bytes)
    pieces = spark.read.parquet(path)
    steps = sorted(r["step"] for r in pieces.select("step").distinct().collect())
    out: dict[str, tuple[str, int, str]] = {}
    for head in (b"", _MARK):
        ended, states = [], {}
        for step in steps:
            rows = pieces.where((F.col("step") == step) & ~F.col("file").isin(list(out))).drop("step")
            for file, size, n, state in _one_step(rows, states, head).collect():
                states[file] = bytes(state), n, size
        for file, (state, n, size) in states.items():
            total = Sha256(state)
            if size - n == 1:
                total.update(b"\n")
            elif size != n:
                ended.append((file, size, n))
                continue
            out[file] = file, size, total.hexdigest()
    if ended:
        raise ValueError(f"files changed while they were read, or are compressed: {ended[:3]}")
    return list(out.values())


def _one_step(rows: DataFrame, states: dict[str, tuple[bytes, int, int]], head: bytes) -> DataFrame:
    """(file, size, bytes so far, state) after a step's pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, n = None, None, 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {
                    "file": pa.array([at[0]], pa.string()),
                    "size": pa.array([at[1]], pa.int64()),
                    "n": pa.array([n], pa.int64()),
                    "state": pa.array([own.state], pa.binary()),
                }
            )

        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column("file")[i].as_py(), batch.column("size")[i].as_py()
                if key != at:
                    if at is not None:
                        yield told()
                    at = key
                    state, n, _ = states.get(key[0], (None, 0, 0))
                    own = Sha256(state)
                    if state is None:
                        own.update(head)
                        n = len(head)
                data = batch.column("data")[i].as_py()
                own.update(data)
                n += len(data)
        if at is not None:
            yield told()

    dealt = rows.repartition("file").sortWithinPartitions("file", "start", "nth")
    return dealt.mapInArrow(run, "file STRING, size BIGINT, n BIGINT, state BINARY")


def check_states() -> None:
    """An error where Python's OpenSSL does not give its states away."""
    try:
        half = Sha256()
        half.update(b"a")
        rest = Sha256(half.state)
        rest.update(b"bc")
        right = rest.hexdigest() == hashlib.sha256(b"abc").hexdigest()
    except (AttributeError, ImportError, OSError) as error:
        raise RuntimeError("Python's OpenSSL does not give SHA-256 states away") from error
    if not right:
        raise RuntimeError("Python's OpenSSL keeps SHA-256 states in another form")
