"""Byte n-grams of texts as packed integers, counted and looked up a batch at a time.

A text is preceded by START bytes and closed by one END; neither occurs in UTF-8."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightmatch.llm.batches import small_batches
from sightmatch.llm.shingles import byte_slices
from sightmatch.sources.scratch import cut

START, END = b"\xfe", b"\xff"
#: Bytes of text in one step, and texts (their number within the step takes 16 bits).
SLICE_BYTES, SLICE_TEXTS = 1 << 20, 1 << 16


def _parts(texts: list[bytes], n: int) -> Iterator[tuple[list[bytes], list[int]]]:
    """Groups of (the n - 1 bytes before and some symbols of a text, number of the text), with at
    most about SLICE_BYTES each; long texts go through several groups."""
    parts, owners, held = [], [], 0
    for number, text in enumerate(texts):
        whole = START * (n - 1) + text + END
        for at in range(0, len(text) + 1, SLICE_BYTES):
            part = whole[at : at + SLICE_BYTES + n - 1]
            if held and held + len(part) > SLICE_BYTES:
                yield parts, owners
                parts, owners, held = [], [], 0
            parts.append(part)
            owners.append(number)
            held += len(part)
    if parts:
        yield parts, owners


def pack(texts: list[bytes], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-gram ending at each symbol, number of its text), END included, a group at a time."""
    for parts, owners in _parts(texts, n):
        raw = np.frombuffer(b"".join(parts), np.uint8)
        keys = np.zeros(len(raw), np.uint64)
        for i in range(n):
            keys[i:] |= raw[: len(raw) - i].astype(np.uint64) << np.uint64(8 * i)
        lengths = np.array([len(p) for p in parts])
        starts = np.cumsum(lengths) - lengths
        symbol = np.ones(len(raw), bool)
        symbol[(starts[:, None] + np.arange(n - 1)).ravel()] = False
        yield keys[symbol], np.repeat(np.array(owners), lengths)[symbol]


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, how often each) of a sorted array."""
    if not len(ordered):
        return ordered, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[first], np.diff(np.append(first, len(ordered)))


def _folded(texts: list[bytes], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(n-gram, number of its text, how often there), sorted by n-gram, a group at a time."""
    for at in range(0, len(texts), SLICE_TEXTS):
        for keys, owner in pack(texts[at : at + SLICE_TEXTS], n):
            tagged = (keys << np.uint64(16)) | owner.astype(np.uint64)
            tagged.sort()
            tagged, times = runs(tagged)
            yield tagged >> np.uint64(16), (tagged & np.uint64(SLICE_TEXTS - 1)).astype(np.int64) + at, times


def sums_by_text(texts: list[bytes], n: int, value_of) -> np.ndarray:
    """Sum over each text's n-grams (n <= 6) of value_of(sorted distinct n-grams)."""
    return sums_and_unknown(texts, n, value_of)[0]


def sums_and_unknown(texts: list[bytes], n: int, value_of) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Sum over each text's n-grams (n <= 6) of value_of(sorted distinct n-grams) without those of
    value NaN; these n-grams of each text and how often each occurs."""
    out, unknown = np.zeros(len(texts)), []
    for keys, owner, times in _folded(texts, n):
        first = np.concatenate(([True], keys[1:] != keys[:-1]))
        values = value_of(keys[first])[np.cumsum(first) - 1]
        left = np.isnan(values)
        if left.any():
            unknown.append((keys[left].view(np.int64), owner[left], times[left]))
            keys, owner, times, values = (x[~left] for x in (keys, owner, times, values))
        out += np.bincount(owner, values * times, len(texts))
    if not unknown:
        return out, [np.zeros(0, np.int64)] * len(texts), [np.zeros(0, np.int64)] * len(texts)
    keys, owner, times = (np.concatenate(x) for x in zip(*unknown, strict=True))
    order = np.argsort(owner, kind="stable")
    ends = np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1]
    return out, np.split(keys[order], ends), np.split(times[order], ends)


class Table:
    """Values by n-gram."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        self.keys, self.values = keys, values

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each key, whether it is there)."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


def counted(docs: DataFrame, n: int, folds: int = 1) -> DataFrame:
    """gram (long), n: how often each n-gram (n <= 6) occurs in the column text of docs. With
    more than one fold (at most 256) also fold, by fold_of(): counts are by fold then.

    Each task folds its own n-grams, a few slices at a time, before they are shuffled."""
    if not 1 <= n <= 6:
        raise ValueError("n-grams of 1 to 6 bytes fit a key")
    low = np.uint64((1 << (8 * n)) - 1)

    def batch_of(keys, times):
        columns = [pa.array((keys & low).view(np.int64)), pa.array(times)]
        columns.append(pa.array((keys >> np.uint64(8 * n)).astype(np.int32)))
        return pa.RecordBatch.from_arrays(columns, ["gram", "n", "fold"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for start, texts in byte_slices(batch.column(0), SLICE_BYTES):
                own = batch.column(1).slice(start, len(texts)).to_numpy().astype(np.uint64)
                for found, owner in pack(texts, n):
                    found |= own[owner] << np.uint64(8 * n)
                    found.sort()
                    distinct, how_often = runs(found)
                    keys, times = _merge(keys, times, distinct, how_often)
                    if len(keys) > 3_000_000:
                        yield batch_of(keys, times)
                        keys, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(keys):
            yield batch_of(keys, times)

    fold = fold_of(F.col("text"), folds) if folds > 1 else F.lit(0)
    rows = small_batches(docs.select("text", fold.alias("fold"))).mapInArrow(run, "gram long, n long, fold int")
    return rows.groupBy(*["fold"][: folds - 1], "gram").agg(F.sum("n").alias("n"))


def fold_of(text: Column, folds: int) -> Column:
    """The fold (int, from 0) of a text by its hash, so that copies of a text share theirs."""
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(folds)).cast("int")


def _merge(keys, times, more, more_times):
    """Two sorted lists of n-grams with counts as one."""
    both = np.concatenate([keys, more])
    order = np.argsort(both, kind="stable")
    both, weight = both[order], np.concatenate([times, more_times])[order]
    first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
    return both[first], np.add.reduceat(weight, first)


def collected(table: DataFrame, most: int) -> Table:
    """The table (gram, n) on the driver; of more than `most` n-grams those above the smallest
    power of two that leaves no more."""
    sizes = table.groupBy(F.floor(F.log2("n")).cast("int").alias("bits")).count().collect()
    left, least = 0, 1
    for row in sorted(sizes, key=lambda r: -r["bits"]):
        if left + row["count"] > most:
            least = 1 << (row["bits"] + 1)
            break
        left += row["count"]
    kept = table.filter(F.col("n") >= least).select("gram", "n").toArrow()
    keys = kept["gram"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return Table(keys[order], kept["n"].to_numpy()[order])


def shorter(table: DataFrame, bytes_kept: int) -> DataFrame:
    """From the table (gram, n) of longer n-grams: how many of them end in each shorter one."""
    suffix = F.col("gram").bitwiseAND((1 << (8 * bytes_kept)) - 1)
    return table.groupBy(suffix.alias("gram")).agg(F.count(F.lit(1)).alias("n"))


def descend(table: Table, n: int) -> list[Table]:
    """From the table of n-grams those of each length from 1 to n, as shorter() makes them."""
    tables = [table]
    for k in range(n - 1, 0, -1):
        suffix = tables[-1].keys & np.uint64((1 << (8 * k)) - 1)
        suffix.sort()
        tables.append(Table(*runs(suffix)))
    return tables[::-1]


def fetched(table: DataFrame) -> Table:
    """The table (gram, n) on the driver, whole."""
    got = table.select("gram", "n").toArrow()
    keys = got["gram"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return Table(keys[order], got["n"].to_numpy()[order])


#: N-grams of all orders in one shard of a dealt model, about.
SHARD_GRAMS = 500_000


class Dealt:
    """A model that stays dealt over the executors because it is too large to be sent to them.

    Tables (gram, n) of each length from 1 to n. All n-grams of three bytes and more whose contexts
    end in the same two bytes are in one shard, and every shard also has those of one and two bytes (65,792 at
    most). So it knows each longer n-gram's contexts whole, and `build(tables)` of a shard gives
    the values of its n-grams as the whole tables would. `hot` holds the values of the most
    frequent n-grams, at most `most_hot`; it is sent to the executors and saves asking for them."""

    def __init__(self, top: DataFrame, n: int, build, most_hot: int):
        self.n, self.build, self.tables = n, build, [top]
        for k in range(n - 1, 0, -1):
            self.tables.insert(0, cut(shorter(self.tables[0], k)))
        self.stats = [count_kinds(t) for t in self.tables]
        self.hot = Table(np.zeros(0, np.uint64), np.zeros(0))
        keys = collected(top, most_hot).keys
        if len(keys):
            least = top.sparkSession.createDataFrame(pa.table({"gram": keys.view(np.int64)}))
            got = self.values(least).toArrow()
            keys, values = got["gram"].to_numpy().view(np.uint64), got["value"].to_numpy()
            order = np.argsort(keys)
            self.hot = Table(keys[order], values[order])

    def values(self, asked: DataFrame) -> DataFrame:
        """gram, value of each of the distinct n-grams in the column gram of asked."""
        few, n, build, stats = [fetched(t) for t in self.tables[:2]], self.n, self.build, self.stats
        shards = 1 + sum(s[0] for s in stats) // SHARD_GRAMS
        low = F.col("gram").bitwiseAND(0xFFFFFF)
        shard = F.pmod(F.xxhash64(F.shiftright(low, 8)), F.lit(shards)).alias("shard")
        rows = None
        for k, table in enumerate(self.tables[2:], 2):
            part = table.select(shard, F.lit(k).alias("k"), "gram", "n")
            rows = part if rows is None else rows.unionAll(part)

        def run(wanted: pa.Table, held: pa.Table) -> pa.Table:
            keys = np.sort(wanted["gram"].to_numpy().view(np.uint64))
            own, lengths = held["gram"].to_numpy().view(np.uint64), held["k"].to_numpy()
            counts, tables = held["n"].to_numpy(), list(few)
            for k in range(2, n):
                here = np.flatnonzero(lengths == k)
                here = here[np.argsort(own[here])]
                tables.append(Table(own[here], counts[here]))
            value_of = build(tables, stats)
            parts = [value_of(keys[i : i + (1 << 20)]) for i in range(0, len(keys), 1 << 20)]
            values = np.concatenate([np.zeros(0), *parts])
            return pa.table({"gram": keys.view(np.int64), "value": values})

        wanted = asked.select("gram").distinct().select(shard, "gram")
        both = wanted.groupBy("shard").cogroup(rows.groupBy("shard"))
        return both.applyInArrow(run, "gram long, value double")

    def completed(self, scored: DataFrame, column: str) -> DataFrame:
        """scored (a stored table with row, unique, and asked and times, arrays of n-grams that are
        not hot and how often) without these two, their values added to the column."""
        pairs = scored.select("row", F.explode(F.arrays_zip("asked", "times")).alias("pair"))
        pairs = pairs.select("row", F.col("pair.asked").alias("gram"), F.col("pair.times").alias("times"))
        more = F.sum(F.col("value") * F.col("times")).alias("__more")
        sums = pairs.join(cut(self.values(pairs)), "gram").groupBy("row").agg(more)
        whole = F.col(column) + F.coalesce("__more", F.lit(0.0))
        return scored.drop("asked", "times").join(sums, "row", "left").withColumn(column, whole).drop("__more")


def hot_value(hot: Table):
    """Values of n-grams by the table, NaN for others."""

    def value_of(keys: np.ndarray) -> np.ndarray:
        at, known = hot.find(keys)
        return np.where(known, hot.values[0][at] if len(hot.keys) else np.nan, np.nan)

    return value_of


def count_kinds(table: DataFrame) -> tuple[int, int, int, int, int]:
    """How many n-grams a table (gram, n) has, and how many with n = 1, 2, 3 and 4."""
    return tuple(table.agg(F.count(F.lit(1)), *[F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)]).first())
