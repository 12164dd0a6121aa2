"""Scoring texts by prediction by partial matching, beside a word-count base."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightmatch.llm import grams
from sightmatch.llm.shingles import byte_slices
from sightmatch.sources.scratch import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = r"[\x20\x09-\x0D]+"


class Trie:
    """Static context trie. Order k holds (context of k bytes, symbol) with counts.

    A symbol is coded in the longest known context; where it was never seen there, an escape is
    coded and the next shorter context goes on without the symbols already ruled out. Escapes
    are estimated as half a count per symbol seen (each symbol's count is lowered by half). Counts
    below the longest order say in how many longer contexts a symbol occurred. What
    no context knows is uniform over the bytes left."""

    def __init__(self, tables: list[grams.Table]):
        self.order = len(tables) - 1
        self.tables = tables
        self.contexts: list[grams.Table] = []
        for k, table in enumerate(tables):
            counts = table.values[0].astype(np.float64)
            context, kinds = grams.runs(table.keys >> np.uint64(8))
            first = np.concatenate(([0], np.cumsum(kinds)[:-1])).astype(np.int64)
            total = np.add.reduceat(counts, first) if len(counts) else counts
            self.contexts.append(grams.Table(context, total, kinds.astype(np.float64)))
        # Of each context, what remains in the next shorter one without its own symbols.
        self.rest: list[tuple[np.ndarray, np.ndarray] | None] = [None]
        for k in range(1, len(tables)):
            mask = np.uint64((1 << (8 * k)) - 1)
            at, there = tables[k - 1].find(tables[k].keys & mask)
            shared = np.where(there, tables[k - 1].values[0][at] if len(at) else 0, 0).astype(float)
            _, kinds = grams.runs(tables[k].keys >> np.uint64(8))
            first = np.concatenate(([0], np.cumsum(kinds)[:-1])).astype(np.int64)
            context = self.contexts[k].keys
            shorter = context & np.uint64((1 << (8 * (k - 1))) - 1)
            at, known = self.contexts[k - 1].find(shorter)
            total, n = (np.where(known, v[at] if len(v) else 0, 0) for v in self.contexts[k - 1].values)
            if len(context):
                total = total - np.add.reduceat(shared, first)
                n = n - np.add.reduceat(there.astype(float), first)
            self.rest.append((total, n))

    def log10_probability(self, keys: np.ndarray) -> np.ndarray:
        """Of the last byte of each gram of order + 1 bytes after the bytes before it."""
        out = np.zeros(len(keys))
        live = np.arange(len(keys))
        # The room and kinds left in the context at hand: None until one is known.
        total, kinds = np.full(len(keys), np.nan), np.full(len(keys), np.nan)
        for k in range(self.order, -1, -1):
            gram = keys[live] & np.uint64((1 << (8 * (k + 1))) - 1)
            at, known = self.contexts[k].find(gram >> np.uint64(8))
            fresh = known & np.isnan(total[live])
            if fresh.any():
                total[live[fresh]] = self.contexts[k].values[0][at[fresh]]
                kinds[live[fresh]] = self.contexts[k].values[1][at[fresh]]
            t, n = total[live], kinds[live]
            usable = known & (t > 0)
            place, seen = self.tables[k].find(gram)
            hit = usable & seen
            counts = self.tables[k].values[0]
            if hit.any():
                out[live[hit]] += np.log10((counts[place[hit]] - 0.5) / t[hit])
            missed = usable & ~seen
            out[live[missed]] += np.log10(0.5 * n[missed] / t[missed])
            if k:
                # Entering the shorter context: what this one leaves of it.
                for values, left in zip((total, kinds), self.rest[k], strict=True):
                    values[live] = np.where(known, left[at] if len(left) else 0, np.nan)
            live = live[~hit]
        seen = len(self.tables[0].keys)
        out[live] += -math.log10(max(1, 256 - seen))
        return out


def training_rows(docs: DataFrame, held_out: Column) -> DataFrame:
    """Column text, A-Z lower-cased, null as empty, of the rows that are learned from."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    return docs.filter(~held_out).select(text.alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    words = F.explode(F.split("text", BLANK)).alias("word")
    return texts.select(words).filter("word != ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def score(
    docs: DataFrame,
    held_out: Column,
    order: int = 5,
    most_grams: int | None = None,
    sent_grams: int = 2_000_000,
    most_words: int = 400_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows where held_out (a column over id `doc_id` and `text`; null counts as false) is false are
    learned from, all are scored over whole texts. A-Z are lower-cased throughout. `score` is
    the log10 probability of the text's bytes and its end under the trie of `order` bytes of
    context; `base_score` sums log10((c + 1) / (N + V + 1)) over words and the text's end.

    N-grams and words are counted over all training rows, folded in each task before they are
    shuffled. A trie of at most sent_grams n-grams of the longest order goes to the executors. A
    larger one stays dealt over them whole (grams.Dealt); the log10 probabilities of at most
    sent_grams frequent n-grams go out, and the distinct others of each text are sent to the shards.
    Both ways give the same scores. Only where most_grams is given, the trie is bounded: each order
    keeps that many n-grams at most, the most frequent ones. Words: at
    most most_words of the frequent ones go to the executors; all other occurrences are joined with
    the counts, which thus have no hot keys. Both ways give the same sums.

    Defined cases: null and empty texts are one token, the end. Without training rows c, N and V are
    0 and every byte is uniform over 256. Null ids and repeated rows are rows like others. An empty
    table gives no rows. Other columns are ignored, whatever their names."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = F.coalesce(held_out, F.lit(False))
    learned = training_rows(docs, held)
    table, tables, dealt = cut(grams.counted(learned, order + 1)), [], None
    if most_grams is not None:
        for k in range(order, -1, -1):
            tables.insert(0, grams.collected(table, most_grams))
            if k:
                table = cut(grams.shorter(table, k))
    elif order < 2 or table.count() <= sent_grams:
        tables = grams.descend(grams.fetched(table), order + 1)
    else:
        dealt = grams.Dealt(table, order + 1, _trie_values, sent_grams)
        tables = [dealt.hot]
    words = cut(word_counts(learned))
    n_texts = learned.count()
    in_words = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    kinds = in_words[0] + (n_texts > 0)
    total = in_words[1] + n_texts
    sizes = words.groupBy(F.floor(F.log2("n")).cast("int").alias("bits")).count().collect()
    left, least = 0, 1
    for row in sorted(sizes, key=lambda r: -r["bits"]):
        if left + row["count"] > most_words:
            least = 1 << (row["bits"] + 1)
            break
        left += row["count"]
    frequent = words.filter(F.col("n") >= least).filter(F.octet_length("word") <= 64).toArrow()
    context = docs.sparkSession.sparkContext
    model = context.broadcast(
        (
            [(t.keys, *t.values) for t in tables],
            frequent["word"].cast(pa.binary()).combine_chunks(),
            frequent["n"].to_numpy(),
        )
    )
    whole, n = dealt is None, order + 1
    name, kind = uuid.uuid4().hex, docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_of, logs = _load(name, model, whole)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start, texts in byte_slices(batch.column(1), grams.SLICE_BYTES):
                texts = [t.lower() for t in texts]
                scores, asked, times = grams.sums_and_unknown(texts, n, value_of)
                tokens, known, sums, rare = [], [], [], []
                for text in texts:
                    own = text.split()
                    found = [logs.get(w) for w in own]
                    have = [x for x in found if x is not None]
                    tokens.append(len(own))
                    known.append(len(have))
                    sums.append(math.fsum(have))
                    rare.append([w for w, x in zip(own, found, strict=True) if x is None])
                columns = {
                    "row": pa.array(range(row, row + len(texts)), pa.int64()),
                    "doc_id": batch.column(0).slice(start, len(texts)),
                    "held_out": batch.column(2).slice(start, len(texts)),
                    "n_words": pa.array(tokens, pa.int64()),
                    "frequent": pa.array(known, pa.int64()),
                    "frequent_sum": pa.array(sums, pa.float64()),
                    "score": pa.array(scores),
                    "rare": pa.array(rare, pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                    "asked": pa.array(asked, pa.list_(pa.int64())),
                    "times": pa.array(times, pa.list_(pa.int64())),
                }
                row += len(texts)
                yield pa.RecordBatch.from_pydict(columns)

    scored = cut(
        docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(
            run,
            f"row long, doc_id {kind}, held_out boolean, n_words long, frequent long, "
            "frequent_sum double, score double, rare array<string>, asked array<long>, times array<long>",
        )
    )
    rare = (
        scored.select("row", F.explode("rare").alias("word"))
        .join(words, "word")
        .groupBy("row")
        .agg(F.count(F.lit(1)).alias("rare"), F.sum(F.log10(F.col("n") + 1)).alias("rare_sum"))
    )
    scored = scored.drop("rare")
    scored = scored.drop("asked", "times") if whole else dealt.completed(scored, "score")
    out = scored.join(rare, "row", "left")
    per_token = math.log10(total + kinds + 1)
    known = F.col("frequent") + F.coalesce("rare", F.lit(0)) + int(n_texts > 0)
    sums = F.col("frequent_sum") + F.coalesce("rare_sum", F.lit(0.0)) + math.log10(n_texts + 1)
    n_tokens = F.col("n_words") + 1
    return out.select(
        "doc_id",
        "held_out",
        n_tokens.alias("n_tokens"),
        known.cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (sums - n_tokens * per_token).alias("base_score"),
        "score",
    )


def _trie_values(tables: list[grams.Table], stats: list):
    return Trie(tables).log10_probability


_LOADED: dict = {}


def _load(name: str, model, whole: bool):
    """What gives the log10 probability of n-grams, by the whole trie or of hot ones only, and
    log10(count + 1) by word, once per worker process and model."""
    if name not in _LOADED:
        _LOADED.clear()
        tables, words, counts = model.value
        logs = dict(zip(words.to_pylist(), np.log10(counts + 1.0).tolist(), strict=True))
        tables = [grams.Table(*t) for t in tables]
        _LOADED[name] = Trie(tables).log10_probability if whole else grams.hot_value(tables[0]), logs
    return _LOADED[name]
