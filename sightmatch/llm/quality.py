"""Quality of texts by an interpolated modified Kneser-Ney model of trusted ones."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightmatch.llm import grams
from sightmatch.llm.batches import free_names, small_batches
from sightmatch.llm.shingles import byte_slices
from sightmatch.sources.scratch import cut

#: Longest n-gram in bytes.
ORDER = 5
#: Rows (fold, n-gram) up to which whole models go to the executors, and n-grams of a dealt model
#: whose values do. The results do not depend on either.
SENT_GRAMS, HOT_GRAMS = 2_000_000, 500_000
#: Trusted ids up to which they are broadcast.
SENT_IDS = 4_000_000
#: Parts of the trusted texts; thresholds come from each as scored by a model of the others.
FOLDS = 5
#: Languages with a threshold of their own; the rest share one.
OWN_THRESHOLDS = 256
#: Symbols of average text that a text is taken to have besides its own: short ones need more.
PRIOR = 100


class KneserNey:
    """p(symbol | context) of n-grams of bytes. The longest order holds counts, shorter ones
    the number of different bytes before the n-gram; three discounts per order. Where the tables are
    a shard's, `sizes` says for each order how many n-grams the whole one has, see count_kinds()."""

    def __init__(self, tables: list[grams.Table], sizes: list[tuple] | None = None):
        self.grams, self.contexts = [], []
        for k, table in enumerate(tables):
            counts = table.values[0]
            once = sizes[k][1:] if sizes else [(counts == i).sum() for i in (1, 2, 3, 4)]
            n1, n2, n3, n4 = (max(1, int(n)) for n in once)
            share = n1 / (n1 + 2 * n2)
            discounts = np.array(
                [0, 1 - 2 * share * n2 / n1, 2 - 3 * share * n3 / n2, 3 - 4 * share * n4 / n3]
            )
            discounts = np.clip(discounts, [0, 0.1, 0.1, 0.1], [0, 0.9, 1.8, 2.7])
            discount = discounts[np.minimum(counts, 3)]
            context, kinds = grams.runs(table.keys >> np.uint64(8))
            first = np.concatenate(([0], np.cumsum(kinds)[:-1])).astype(np.int64)
            if len(counts):
                total = np.add.reduceat(counts.astype(float), first)
                taken = np.add.reduceat(discount, first)
            else:
                total = taken = np.zeros(0)
            self.grams.append(grams.Table(table.keys, (counts - discount) / np.repeat(total, kinds)))
            self.contexts.append(grams.Table(context, taken / np.maximum(total, 1)))

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """-log2 of the probability of each n-gram's last byte; 256 symbols are possible."""
        p = np.full(len(keys), 1 / 256)
        for k, (own, left) in enumerate(zip(self.grams, self.contexts, strict=True)):
            gram = keys & np.uint64((1 << (8 * (k + 1))) - 1)
            at, known = left.find(gram >> np.uint64(8))
            if known.any():
                p *= np.where(known, left.values[0][at], 1.0)
                at, known = own.find(gram)
                p += np.where(known, own.values[0][at], 0.0)
        return -np.log2(p)


class DealtKneserNey(grams.Dealt):
    """A KneserNey that is too large to be sent; it stays dealt over the executors."""

    def __init__(self, top: DataFrame):
        super().__init__(top, ORDER, lambda tables, sizes: KneserNey(tables, sizes).bits, HOT_GRAMS)


Model = KneserNey | DealtKneserNey


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of the texts of docs whose ids are in trusted (column doc_id), see fits()."""
    return fits(docs, trusted, 1, id_col, text_col)[0]


def fits(
    docs: DataFrame, trusted: DataFrame, folds: int, id_col: str = "doc_id", text_col: str = "text"
) -> list[Model]:
    """A model of the texts of docs whose ids are in trusted (column doc_id), and with more than
    one fold a model without the texts of each. All rows of trusted ids are counted whole; counts
    too many to be sent out make models that stay dealt over the executors."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(
        _distinct_ids(trusted), F.col("doc_id") == F.col("__id"), "left_semi"
    )
    by_fold = cut(grams.counted(texts, ORDER, folds))
    if by_fold.count() > SENT_GRAMS:
        whole = by_fold.groupBy("gram").agg(F.sum("n").alias("n"))
        parts = [whole]
        for i in range(folds if folds > 1 else 0):
            parts.append(by_fold.filter(F.col("fold") != i).groupBy("gram").agg(F.sum("n").alias("n")))
        return [DealtKneserNey(cut(part)) for part in parts]
    got = by_fold.toArrow()
    keys, times = got["gram"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    fold = got["fold"].to_numpy()[order] if folds > 1 else np.zeros(len(keys), np.int32)
    models = []
    for left_out in range(-1, folds if folds > 1 else 0):
        own = fold != left_out
        distinct, rows = grams.runs(keys[own])
        counts = np.add.reduceat(times[own], np.cumsum(rows) - rows) if len(rows) else times[own]
        models.append(KneserNey(grams.descend(grams.Table(distinct, counts), ORDER)))
    return models


def _distinct_ids(trusted: DataFrame) -> DataFrame:
    """Column __id; broadcast unless they are more than SENT_IDS, so that no texts are shuffled."""
    ids = cut(trusted.select(F.col("doc_id").alias("__id")).filter("__id IS NOT NULL").distinct())
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def _scorer(docs: DataFrame, models: list[Model]):
    """A function from texts (bytes) and the number of each one's model to (bits, symbols, n-grams
    whose bits only a dealt model knows, how often each); models, or of dealt ones what is hot,
    go out once per executor."""
    context = docs.sparkSession.sparkContext
    whole = isinstance(models[0], KneserNey)
    shipped = [context.broadcast(m if whole else m.hot) for m in models]

    def score(texts: list[bytes], which: np.ndarray):
        bits, asked, times = np.zeros(len(texts)), [None] * len(texts), [None] * len(texts)
        for m in np.unique(which):
            own = np.flatnonzero(which == m)
            model = shipped[m].value
            value_of = model.bits if whole else grams.hot_value(model)
            bits[own], more, often = grams.sums_and_unknown([texts[i] for i in own], ORDER, value_of)
            for i, keys, n in zip(own, more, often, strict=True):
                asked[i], times[i] = keys, n
        return bits, np.array([len(t) + 1 for t in texts], np.int64), asked, times

    return score


def perplexities(
    docs: DataFrame,
    model: Model | list[Model],
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """One row per row of docs: doc_id, lang, bits (of the whole text and its end), n_symbols.
    Of a list of models the one of the text's fold scores it."""
    models = model if isinstance(model, list) else [model]
    score, id_type = _scorer(docs, models), docs.schema[id_col].dataType.simpleString()

    whole = isinstance(models[0], KneserNey)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start, texts in byte_slices(batch.column(2), grams.SLICE_BYTES):
                own = batch.slice(start, len(texts))
                bits, n, asked, times = score(texts, own.column(3).to_numpy())
                columns = {
                    "doc_id": own.column(0),
                    "lang": own.column(1),
                    "bits": pa.array(bits),
                    "n_symbols": pa.array(n),
                }
                if not whole:
                    columns["fold"] = own.column(3)
                    columns["row"] = pa.array(range(row, row + len(texts)), pa.int64())
                    columns["asked"] = pa.array(asked, pa.list_(pa.int64()))
                    columns["times"] = pa.array(times, pa.list_(pa.int64()))
                row += len(texts)
                yield pa.RecordBatch.from_pydict(columns)

    picked = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).alias("text"),
        grams.fold_of(F.col(text_col), len(models)).alias("fold"),
    )
    schema = f"doc_id {id_type}, lang string, bits double, n_symbols long"
    if whole:
        return small_batches(picked).mapInArrow(run, schema)
    schema += ", fold int, row long, asked array<long>, times array<long>"
    scored = cut(small_batches(picked).mapInArrow(run, schema))
    parts = [m.completed(scored.filter(F.col("fold") == i), "bits") for i, m in enumerate(models)]
    return reduce(DataFrame.unionAll, parts).drop("fold", "row")


def thresholds(
    docs: DataFrame,
    trusted: DataFrame,
    models: list[Model],
    quantile: float,
    slack: float,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> dict[str | None, tuple[float, float]]:
    """Per language (median bits a symbol of trusted texts, threshold): the quantile of their
    settled bits a symbol, see judge(), times 1 + slack. None: over all languages. Each trusted
    text is scored by that of the models which has not seen its fold."""
    rate = F.col("bits") / F.col("n_symbols")
    held_out = docs.select(id_col, text_col, lang_col)
    held_out = held_out.join(_distinct_ids(trusted), F.col(id_col) == F.col("__id"), "left_semi")
    own = cut(
        perplexities(held_out, models, id_col, text_col, lang_col).select(
            F.coalesce("lang", F.lit("")).alias("lang"), "bits", "n_symbols", rate.alias("rate")
        )
    )
    most = own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(OWN_THRESHOLDS)
    wide = own.filter("n_symbols >= 200")
    middle = F.percentile_approx("rate", 0.5, 10_000).alias("middle")
    middles = {r["lang"]: r["middle"] for r in wide.groupBy("lang").agg(middle).join(F.broadcast(most), "lang").collect()}
    middles[None] = wide.agg(middle).first()["middle"]
    if middles[None] is None:
        middles[None] = own.agg(middle).first()["middle"]
    if middles[None] is None:
        return {}
    table = own.sparkSession.createDataFrame(
        [(k, float(v)) for k, v in middles.items() if k is not None], "lang string, middle double"
    )
    settled = own.join(F.broadcast(table), "lang", "left").withColumn(
        "middle", F.coalesce("middle", F.lit(float(middles[None])))
    )
    settled = settled.withColumn("rate", (F.col("bits") + PRIOR * F.col("middle")) / (F.col("n_symbols") + PRIOR))
    top = F.percentile_approx("rate", quantile, 10_000).alias("top")
    tops = {r["lang"]: r["top"] for r in settled.groupBy("lang").agg(top).collect() if r["lang"] in middles}
    tops[None] = settled.agg(top).first()["top"]
    return {k: (middles.get(k, middles[None]), tops[k] * (1 + slack)) for k in tops}


def settled_rate(bits, n_symbols, middle):
    """Bits a symbol, with PRIOR symbols at the language's median besides the text's own."""
    return (bits + PRIOR * middle) / (n_symbols + PRIOR)


def judge(
    docs: DataFrame,
    trusted: DataFrame,
    quantile: float = 0.995,
    slack: float = 0.03,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """One row per row of docs: doc_id, lang, perplexity (per byte), threshold, kept.

    The model is fitted on trusted texts (fit()); every whole text is scored. Kept are texts whose
    settled perplexity is at most the language's threshold, a quantile over all trusted texts of
    that language, widened by `slack` (in bits). For the quantiles trusted texts are dealt into FOLDS
    parts by their hash and scored by a model fitted without their part, so a threshold is that of
    unseen texts at every size.

    Defined cases: null and empty texts are the end alone, which is judged like other texts. A null
    language is a language, the same as one with an empty name. Languages without trusted texts, and those beyond the OWN_THRESHOLDS
    most frequent ones, use the quantile over all trusted texts. Without any trusted text threshold
    is null and all are kept. Null ids cannot be trusted, repeated rows are rows like others. An
    empty table gives no rows. Other columns are ignored, whatever their names."""
    renamed = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    model, *others = fits(renamed, trusted, FOLDS)
    scored = cut(perplexities(renamed, model))
    limits = thresholds(renamed, trusted, others, quantile, slack)
    middle, top = limits.get(None, (None, None))
    spark = docs.sparkSession
    rows = [(k, float(m), float(t)) for k, (m, t) in limits.items() if k is not None]
    table = spark.createDataFrame(rows, "__lang string, middle double, top double")
    known = scored.join(F.broadcast(table), F.coalesce("lang", F.lit("")) == F.col("__lang"), "left")
    middle = F.coalesce("middle", F.lit(middle).cast("double"))
    top = F.coalesce("top", F.lit(top).cast("double"))
    rate = settled_rate(F.col("bits"), F.col("n_symbols"), middle)
    return known.select(
        "doc_id",
        "lang",
        F.pow(F.lit(2.0), F.col("bits") / F.col("n_symbols")).alias("perplexity"),
        F.pow(F.lit(2.0), top).alias("threshold"),
        F.coalesce(rate <= top, F.lit(True)).alias("kept"),
    )


def keep_good(
    docs: DataFrame,
    trusted: DataFrame,
    quantile: float = 0.995,
    slack: float = 0.03,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns. Trusted texts are scored
    twice, for the thresholds and for the choice. Texts are shuffled only with a dealt model.

    Defined cases: as for judge(). Without any trusted text, and from an empty table, all rows stay.
    Other columns are passed on, whatever their names."""
    model, *others = fits(docs, trusted, FOLDS, id_col, text_col)
    limits = thresholds(docs, trusted, others, quantile, slack, id_col, text_col, lang_col)
    if not limits:
        return docs
    if isinstance(model, DealtKneserNey):
        return _keep_by_hash(docs, model, limits, text_col, lang_col)
    score, at = _scorer(docs, [model]), docs.columns.index(text_col)
    by_lang = docs.columns.index(lang_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for start, texts in byte_slices(batch.column(at), grams.SLICE_BYTES):
                bits, n, _, _ = score(texts, np.zeros(len(texts), np.int64))
                langs = batch.column(by_lang).slice(start, len(texts)).to_pylist()
                limit = np.array([limits.get(x or "", limits[None]) for x in langs]).reshape(-1, 2)
                keep[start : start + len(texts)] = settled_rate(bits, n, limit[:, 0]) <= limit[:, 1]
            yield batch.filter(pa.array(keep))

    return small_batches(docs).mapInArrow(run, docs.schema)


def _keep_by_hash(
    docs: DataFrame, model: DealtKneserNey, limits: dict, text_col: str, lang_col: str
) -> DataFrame:
    """keep_good() with a dealt model. What is kept depends on text and language alone, so the
    verdicts come back by these, the text as its SHA-256."""
    hashed, of_lang = free_names(docs, "hashed", "of_lang")
    text_hash = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    keyed = docs.select(text_hash.alias(hashed), F.col(text_col).alias("text"), lang.alias("lang"))
    scored = perplexities(keyed, model, hashed)
    rows = [(k, float(m), float(t)) for k, (m, t) in limits.items() if k is not None]
    table = docs.sparkSession.createDataFrame(rows, "lang string, middle double, top double")
    middle, top = (F.coalesce(c, F.lit(float(x))) for c, x in zip(("middle", "top"), limits[None], strict=True))
    good = scored.join(F.broadcast(table), "lang", "left").filter(
        settled_rate(F.col("bits"), F.col("n_symbols"), middle) <= top
    )
    good = good.select(F.col("doc_id").alias(hashed), F.col("lang").alias(of_lang)).distinct()
    return docs.join(good, (text_hash == F.col(hashed)) & (lang == F.col(of_lang)), "left_semi")
