"""Harmonic packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightmatch.llm import bpe
from sightmatch.llm.batches import small_batches
from sightmatch.sources.scratch import cut

#: Documents are cut to capacity // k for k up to LAST_CUT; shorter tails stay whole.
LAST_CUT = 16
#: Workers whose left-over pieces are joined in one round.
FAN_IN = 64


def piece_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: whole sequences, then the largest capacity // k that
    still fits, then a tail below capacity // LAST_CUT."""
    out, sizes = [capacity] * (n // capacity), [capacity // k for k in range(2, LAST_CUT + 1)]
    rest = n % capacity
    for size in sizes:
        if size and size <= rest:
            out.append(size)
            rest -= size
    return out + [rest] * (rest > 0)


class _Bins:
    """Open bins of one worker: class k (lengths in (capacity/(k+1), capacity/k]) takes k pieces."""

    def __init__(self, capacity: int, first_bin: int):
        self.capacity, self.next_bin = capacity, first_bin
        self.open: dict[int, list[tuple]] = {}

    def close(self, pieces: list[tuple]) -> Iterator[tuple]:
        """The pieces (…, length last) with sequence and offset."""
        at, number = 0, self.next_bin
        self.next_bin += 1
        for piece in pieces:
            yield (*piece, number, at)
            at += piece[-1]

    def add(self, piece: tuple) -> Iterable[tuple]:
        k = self.capacity // piece[-1]
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) < k:
            return ()
        del self.open[k]
        return self.close(held)

    def left(self) -> Iterator[tuple]:
        for held in self.open.values():
            for piece in held:
                yield (*piece, None, None)

    def mixed(self) -> Iterator[tuple]:
        """The last pieces, fewer than the sum of k over all classes: first fit by length."""
        bins: list[list] = []
        pieces = sorted((p for held in self.open.values() for p in held), key=lambda p: -p[-1])
        for piece in pieces:
            for room in bins:
                if room[0] >= piece[-1]:
                    break
            else:
                bins.append(room := [self.capacity, []])
            room[0] -= piece[-1]
            room[1].append(piece)
        for _, held in bins:
            yield from self.close(held)


def pack(
    docs: DataFrame,
    source: tuple,
    capacity: int = 1024,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    with keep_ids the packed ids. `source` as in bpe.load().

    Each document (its ids, then end_id) is cut into whole sequences and a rest of few pieces whose
    lengths are capacity // k, so k of them fill a sequence but for less than k tokens. Each worker
    fills the bins of each class on its own; its pieces in unfilled bins, fewer than a constant, are
    regrouped FAN_IN workers at a time until one is left, which fills the last bins from all
    classes. Sequence ids come from round, partition and a counter, so a lost task makes the same.

    Defined cases: null and empty texts are the end_id alone. Nulls and repeats in id_col are passed
    on, each row is packed for itself. An empty table gives no rows. Other columns are ignored,
    whatever their names."""
    kind = docs.schema[id_col].dataType.simpleString()
    fields = ["doc_id", "start", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids + ["length"]
    types = [None, pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids + [pa.int64()]
    schema = f"doc_id {kind}, start long, ids_crc32 long, doc_tokens long, "
    schema += "ids binary, " * keep_ids + "length long, sequence_id long, offset long"
    end = end_id.to_bytes(4, "little")

    def as_batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        kinds = [id_type, *types[1:], pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
            [*fields, "sequence_id", "offset"],
        )

    def fill(pieces: Iterable[tuple], id_types: list, level: int, last: bool):
        from pyspark import TaskContext

        bins = _Bins(capacity, (level << 56) + (TaskContext.get().partitionId() << 32))
        out: list[tuple] = []
        for piece in pieces:
            out.extend(bins.add(piece))
            if len(out) >= 20_000:
                yield as_batch(out, id_types[0])
                out = []
        out.extend(bins.mixed() if last else bins.left())
        if out:
            yield as_batch(out, id_types[0])

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_types: list[pa.DataType] = []

        def pieces() -> Iterator[tuple]:
            model = bpe.load(source)
            for batch in batches:
                id_types[:] = [batch.column(0).type]
                for row, texts in bpe.text_slices(batch.column(1)):
                    names = batch.column(0).slice(row, len(texts)).to_pylist()
                    for name, ids in zip(names, model.encode(texts), strict=True):
                        ids += end
                        n, at = len(ids) // 4, 0
                        for length in piece_lengths(n, capacity):
                            own = ids[4 * at : 4 * (at + length)]
                            kept = (own,) * keep_ids
                            yield (name, at, zlib.crc32(own), n, *kept, length)
                            at += length

        yield from fill(pieces(), id_types, 0, False)

    def again(level: int, last: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            id_types: list[pa.DataType] = []

            def pieces() -> Iterator[tuple]:
                for batch in batches:
                    id_types[:] = [batch.column(0).type]
                    yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

            yield from fill(pieces(), id_types, level, last)

        return run

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    packed = cut(small_batches(picked).mapInArrow(first, schema))
    done, level = [packed.filter("sequence_id IS NOT NULL")], 1
    left = packed.filter("sequence_id IS NULL").select(fields)
    workers = packed.rdd.getNumPartitions()
    while True:
        workers = max(1, -(-workers // FAN_IN))
        packed = cut(left.coalesce(workers).mapInArrow(again(level, workers == 1), schema))
        done.append(packed.filter("sequence_id IS NOT NULL"))
        if workers == 1:
            break
        left, level = packed.filter("sequence_id IS NULL").select(fields), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return out.select(columns + ["ids"] * keep_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (packed, unpadded) and length of each sequence, from pack(keep_ids=True).
    A sequence has at most `capacity` pieces, so each group is small."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda all_ids, part: F.concat(all_ids, part["ids"])).alias("ids"),
        "length",
    )
