"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightmatch.llm.batches import small_batches
from sightmatch.llm.shingles import byte_slices

#: Bins of the n-gram features, longest n-gram, bytes of text in one step.
BINS, LONGEST, SLICE_BYTES = 1 << 12, 3, 1 << 20
#: Languages that can be told apart; more are an error.
MOST_LANGUAGES = 256
#: Bytes of the short second example that each training row gives.
EXCERPT = 60
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
# Letters stay, other ASCII characters are blanks: digits and marks say nothing of a language.
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def features(texts: list[bytes]) -> np.ndarray:
    """A row of unit length per text: root shares of its hashed n-grams of 1 to LONGEST bytes.
    A long text is counted in parts of SLICE_BYTES; n-grams over their edges are left out."""
    counts = np.zeros((len(texts), BINS))
    for i, text in enumerate(texts):
        if len(text) > 2 * SLICE_BYTES:
            for at in range(0, len(text), SLICE_BYTES):
                counts[i] += _counts([text[at : at + SLICE_BYTES]])[0]
    short = [i for i, text in enumerate(texts) if len(text) <= 2 * SLICE_BYTES]
    if short:
        counts[short] = _counts([texts[i] for i in short])
    shares = np.sqrt(counts)
    length = np.sqrt((shares**2).sum(axis=1, keepdims=True))
    return (shares / np.maximum(length, 1e-9)).astype(np.float32)


def _counts(texts: list[bytes]) -> np.ndarray:
    data = b"".join(b" " + t.lower().translate(_FOLD) + b" " for t in texts)
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) + 2 for t in texts])
    counts = np.zeros(len(texts) * BINS)
    code = raw.copy()
    for n in range(1, LONGEST + 1):
        if n > 1:
            code = (code[:-1] << np.uint32(8)) | raw[n - 1 :]
        own = owner[: len(code)]
        inside = own == owner[n - 1 :]
        # Runs of blanks are not evidence.
        inside &= (raw[: len(code)] != 32) | (raw[n - 1 :] != 32)
        bins = ((code * np.uint32(0x9E3779B1) + np.uint32(n)) * np.uint32(0x85EBCA6B)) >> np.uint32(20)
        counts += np.bincount(
            own[inside] * BINS + bins[inside].astype(np.int64), minlength=len(counts)
        )
    return counts.reshape(len(texts), BINS)


def codewords(n: int) -> np.ndarray:
    """A row of +1 / -1 bits per language: every split in two for up to 5 languages, else random
    splits, the set of 100 with the largest least distance."""
    if n <= 5:
        splits = range(1, 1 << max(0, n - 1))
        return np.array([[1 if s >> i & 1 else -1 for s in splits] for i in range(n)]).reshape(n, -1)
    rng, best, apart = np.random.default_rng(7), None, -1
    bits = 15 * int(np.ceil(np.log2(n)))
    for _ in range(100):
        tried = rng.choice([-1, 1], (n, bits))
        distance = (bits - tried @ tried.T) // 2
        least = distance[~np.eye(n, dtype=bool)].min()
        if least > apart and (np.abs(tried.sum(axis=0)) < n).all():
            best, apart = tried, least
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BINS, 0), np.float32))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    trust: np.ndarray = field(default_factory=lambda: np.zeros(0))
    margin: float = 0.2

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, ambiguous) of each text. The score is the nearest codeword's share of
        exp(-loss); it is ambiguous if the second nearest one's is within `margin`."""
        n = len(texts)
        names, score, doubt = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
        lettered = [i for i, t in enumerate(texts) if _LETTER.search(t.decode("utf-8", "replace"))]
        if not lettered or not self.languages:
            return names, score, doubt
        if len(self.languages) == 1:
            for i in lettered:
                names[i], score[i], doubt[i] = self.languages[0], 1.0, False
            return names, score, doubt
        said = features([texts[i] for i in lettered]) @ self.weights + self.offsets
        agree = np.logaddexp(0, -said) * self.trust  # loss of a bit that is +1
        differ = np.logaddexp(0, said) * self.trust
        up = (self.codes > 0).astype(float)
        loss = agree @ up.T + differ @ (1 - up).T
        # In units of a bit's mean trust; the root of the number of languages softens longer codes.
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * 2 / self.trust.mean() / np.sqrt(loss.shape[1]))
        share /= share.sum(axis=1, keepdims=True)
        order = np.argsort(-share, axis=1, kind="stable")
        first = share[np.arange(len(share)), order[:, 0]]
        second = share[np.arange(len(share)), order[:, 1]]
        for k, i in enumerate(lettered):
            names[i] = self.languages[order[k, 0]]
        score[lettered], doubt[lettered] = first, first - second < self.margin
        return names, score, doubt


def _fit_bits(
    x: np.ndarray, y: np.ndarray, used: np.ndarray, steps: int = 150
) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions, one per column of y (+1 / -1), by accelerated gradient steps. The last
    column of x is 1; rows count where `used` is 1, and not where it is 0."""
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    ahead, rate, ridge = w, 2.0, 1e-4
    part = (used / used.sum()).astype(np.float32)[:, None]
    for t in range(steps):
        slope = x.T @ (-y * part / (1 + np.exp(y * (x @ ahead)))) + ridge * ahead
        new = ahead - rate * slope.astype(np.float32)
        ahead, w = new + (t / (t + 3)) * (new - w), new
    return w[:-1], w[-1]


def fit(
    docs: DataFrame,
    learn: Column | None = None,
    per_language: int = 400,
    most_rows: int = 2_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> LanguageModel:
    """Fit on at most per_language rows of each value of lang_col (most_rows in all, but 8 of
    each), picked by a hash of id, text and place among the rows where `learn` holds and language
    and text are not null. Rows are thinned by the hash to about eight times as many before
    they are ranked. What reaches the driver is two vectors of at most BINS features per row,
    without the zeros, whatever the texts' lengths."""
    rows = small_batches(docs if learn is None else docs.filter(learn))
    rows = rows.select(
        F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).alias("text"),
        F.xxhash64(id_col, text_col, F.monotonically_increasing_id()).alias("at"),
    ).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has over {MOST_LANGUAGES} values")
    per_language = min(per_language, max(8, most_rows // max(1, len(counts))))
    shares = docs.sparkSession.createDataFrame(
        [(r["lang"], min(1.0, 8 * per_language / r["count"])) for r in counts],
        "lang string, share double",
    )
    thin = F.pmod(F.col("at"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("at"))
    picked = (
        rows.join(F.broadcast(shares), "lang")
        .filter(thin)
        .withColumn("nth", nth)
        .filter(F.col("nth") <= per_language)
        .select("lang", "text", "at")
    )
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(2).to_pylist()
            for start, texts in byte_slices(batch.column(1), SLICE_BYTES):
                use = [i for i, t in enumerate(texts) if _LETTER.search(t.decode("utf-8", "replace"))]
                short = []
                for i in use:
                    begin = places[start + i] % max(1, len(texts[i]) - EXCERPT)
                    short.append(texts[i][begin : begin + EXCERPT])
                x = features([texts[i] for i in use] + short)
                own = batch.column(0).take(pa.array([start + i for i in use], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([own, own]),
                        pa.array([_sparse(v) for v in x], pa.binary()),
                    ],
                    ["lang", "x"],
                )

    found = picked.mapInArrow(run, "lang string, x binary").toArrow()
    # The same model in any order of the rows.
    found = found.sort_by([("lang", "ascending"), ("x", "ascending")])
    names = found["lang"].to_pylist()
    languages = sorted(set(names))
    if len(languages) < 2:
        return LanguageModel(languages)
    x = np.zeros((len(names), BINS + 1), np.float32)
    x[:, BINS] = 1
    for row, packed in zip(x, found["x"], strict=True):
        bins, values = _dense(packed.as_buffer())
        row[bins] = values
    del found
    codes = codewords(len(languages))
    number = {name: i for i, name in enumerate(languages)}
    y = codes[[number[name] for name in names]].astype(np.float32)
    # Each bit's error on every fifth example, by a fit without them, is its weight in decoding.
    aside = np.arange(len(x)) % 5 == 0
    w, b = _fit_bits(x, y, ~aside, 60)
    wrong = ((x[::5, :BINS] @ w + b) * y[::5] <= 0).sum(axis=0)
    error = np.clip((wrong + 1) / (aside.sum() + 2), 0.001, 0.49)
    w, b = _fit_bits(x, y, np.ones(len(x)))
    return LanguageModel(languages, codes, w, b, np.log((1 - error) / error))


def _sparse(v: np.ndarray) -> bytes:
    """The bins that are not 0, as 16-bit numbers, and their values."""
    bins = np.flatnonzero(v)
    return bins.astype(np.uint16).tobytes() + v[bins].tobytes()


def _dense(packed: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    n = packed.size // 6
    raw = np.frombuffer(packed, np.uint8)
    return raw[: 2 * n].view(np.uint16), np.frombuffer(raw[2 * n :].tobytes(), np.float32)


def predict(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score (0 to 1), ambiguous.

    Features of the whole text only. Each bit of the codewords has a classifier; the losses of all
    bits, weighted by how reliable each is, give the distance to every codeword.

    Defined cases: null texts and texts without a letter are `und` with score 0 and ambiguous, and
    so is every text if nothing was learned; with one language learned all others are
    it, with score 1. Nulls and repeats in id_col are passed on. An empty table gives no rows.
    Other columns are ignored, whatever their names."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in byte_slices(batch.column(1), SLICE_BYTES):
                names, score, doubt = model.predict(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(texts)),
                        pa.array(names, pa.string()),
                        pa.array(score),
                        pa.array(doubt),
                    ],
                    ["doc_id", "lang_pred", "score", "ambiguous"],
                )

    return small_batches(docs.select(id_col, text_col)).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean"
    )


def keep_known(
    docs: DataFrame, model: LanguageModel, least: float = 0.0, text_col: str = "text"
) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a language by predict() with a
    score of at least `least`; texts that are `und` go.

    Defined cases: as for predict(), so null texts, those without a letter, and all texts where
    nothing was learned go. Repeated rows are rows like others. An empty table gives no rows. Other
    columns are passed on, whatever their names."""
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for start, texts in byte_slices(batch.column(at), SLICE_BYTES):
                names, score, _ = model.predict(texts)
                known = np.array([n != UNKNOWN for n in names], bool)
                keep[start : start + len(texts)] = known & (score >= least)
            yield batch.filter(pa.array(keep))

    return small_batches(docs).mapInArrow(run, docs.schema)
