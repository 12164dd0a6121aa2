"""Token counts by a sentencepiece model, without keeping the tokens."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightmatch.llm.batches import small_batches

#: Bytes of text in one call of the library; longer texts are cut where that changes nothing.
CALL_BYTES, PIECE_CHARS = 1 << 20, 1 << 18

# A single blank between two ASCII letters or digits: the normaliser and the mark that the
# library puts before each text make the part after it what it is in the whole text.
_SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")

_LOADED: dict = {}


def _load(path: str):
    if path not in _LOADED:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        mark = "▁"
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        # Cuts are safe only if no piece reaches over a word's start, and the mark is put there.
        crossing = any(mark in p.lstrip(mark) for p in pieces)
        marked = model.encode("a", out_type=str)[:1] == model.encode("b a", out_type=str)[-1:]
        _LOADED[path] = model, not crossing and marked
    return _LOADED[path]


def safe_parts(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """Parts of at most about `limit` characters, without the blanks between them; a stretch
    without a safe blank stays whole."""
    start = 0
    while len(text) - start > limit:
        found = _SAFE.search(text, start + limit)
        if not found:
            break
        yield text[start : found.start()]
        start = found.end()
    yield text[start:]


def count_tokens(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Within each Arrow batch texts are regrouped into calls of about CALL_BYTES, and only
    lengths are returned. Texts over PIECE_CHARS are cut at single blanks between ASCII letters or
    digits, if the model's pieces never reach over a word's start.

    Defined cases: null and empty texts have no tokens. Nulls and repeats in id_col are passed on.
    An empty table gives no rows. Other columns are ignored, whatever their names."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, can_cut = _load(model_path)
        for batch in batches:
            n = batch.num_rows
            counts = np.zeros(n, np.int64)
            call: list[str] = []
            rows: list[int] = []
            held = 0

            def count() -> None:
                lengths = [len(x) for x in model.encode(call, num_threads=1)]
                np.add.at(counts, rows, lengths)

            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0)
            for i, text in enumerate(batch.column(1)):
                whole = text.as_py() or ""
                for part in safe_parts(whole) if can_cut else (whole,):
                    call.append(part)
                    rows.append(i)
                    held += len(part)
                    if held >= CALL_BYTES:
                        count()
                        call, rows, held = [], [], 0
            if call:
                count()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    sizes.cast(pa.int64()),
                    pa.array(counts),
                    pa.array(counts > limit),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return small_batches(picked).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
