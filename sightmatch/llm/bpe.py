"""Byte-level BPE over Arrow batches: encode, offsets, decode."""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightmatch.llm.batches import small_batches

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of text that are encoded at once, and distinct units whose ids are remembered.
SLICE_BYTES, UNITS_KEPT = 1 << 20, 90_000

# A blank after another one: the cut at single blanks does not hold for such a text.
_RUN = re.compile(r"\s ")
_UNIT = re.compile(r"\s*\S+|\s+")
# Letters, then marks that are neither letters, digits, blanks nor the apostrophe: two pre-tokens.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in printable}
    for b in range(256):
        shown.setdefault(b, chr(256 + len(shown) - len(printable)))
    return [shown[b] for b in range(256)]


def from_ranks(ranks_path: str, pattern: str):
    """A tokenizers.Tokenizer for a file of ranks, and the bytes of each id.

    Every way to put a token together from two others is a merge, with the token's rank, as
    in the merging by ranks; a piece that is a token is taken whole."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks: dict[bytes, int] = {}
    with open(ranks_path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    shown = byte_characters()
    spell = {token: "".join(shown[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        halves = ((token[:i], token[i:]) for i in range(1, len(token)))
        whole = [(ranks[a], ranks[b], a, b) for a, b in halves if a in ranks and b in ranks]
        merges += [(spell[a], spell[b]) for _, _, a, b in sorted(whole)]
    made = Tokenizer(
        models.BPE(vocab={spell[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
    )
    made.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    return made, {rank: token for token, rank in ranks.items()}


def from_json(path: str):
    """A tokenizers.Tokenizer read from its own format, and the bytes of each id."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_padding()
    made.no_truncation()
    value = {c: b for b, c in enumerate(byte_characters())}
    special = {i for i, t in made.get_added_tokens_decoder().items() if t.special}
    return made, {
        i: token.encode() if i in special else bytes(value[c] for c in token)
        for token, i in made.get_vocab().items()
    }


class ByteBpe:
    """Encodes whole texts. Texts are cut only where a blank follows a non-blank, which no
    pre-token crosses; the ids of the units between are remembered, since most occur again."""

    def __init__(self, tokenizer, tokens: dict[int, bytes]):
        self.tokenizer = tokenizer
        self.tokens = tokens
        self._spelling = dict(enumerate(byte_characters()))
        # What follows a blank, and other units: those in use, and those of some time ago.
        self._now: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self._before: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self._marks: dict[str, list[int]] = {}

    def _ids(self, pre_token: str) -> list[int]:
        """Of one pre-token, by the merges alone."""
        spelled = pre_token.encode().decode("latin-1").translate(self._spelling)
        return [token.id for token in self.tokenizer.model.tokenize(spelled)]

    def _learn(self, units: set[str], spaced: bool) -> dict[str, bytes]:
        now, before = self._now[not spaced], self._before[not spaced]
        lead, other = " " * spaced, []
        for unit in units.difference(now):
            if unit in before:
                now[unit] = before[unit]
            elif simple := _SIMPLE.match(unit):
                word, marks = simple.groups()
                ids = self._ids(lead + word)
                if marks:
                    if marks not in self._marks:
                        self._marks[marks] = self._ids(marks)
                    ids = ids + self._marks[marks]
                now[unit] = array("I", ids).tobytes()
            else:
                other.append(unit)
        for i in range(0, len(other), 10_000):
            part = other[i : i + 10_000]
            found = self.tokenizer.encode_batch_fast([lead + u for u in part], add_special_tokens=False)
            now.update(zip(part, (array("I", x.ids).tobytes() for x in found), strict=True))
        return now

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed little-endian unsigned 32-bit integers."""
        if sum(map(len, self._now)) > UNITS_KEPT:
            self._before, self._now, self._marks = self._now, ({}, {}), {}
        simple, other, first = {}, {}, {}
        for i, text in enumerate(texts):
            if not text:
                continue
            if _RUN.search(text):
                other[i] = _UNIT.findall(text)
            else:
                first[i], *simple[i] = text.split(" ")
        spaced = self._learn(set().union(*simple.values()), True).__getitem__
        plain = self._learn(set(first.values()).union(*other.values()) - {""}, False)
        out = []
        for i in range(len(texts)):
            if i in simple:
                lead = plain[first[i]] if first[i] else b""
                out.append(lead + b"".join(map(spaced, simple[i])))
            else:
                out.append(b"".join(map(plain.__getitem__, other.get(i, ()))))
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", packed)))

    def spans(self, text: str, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Per token the characters [start, end) that its bytes touch; a character that is split
        over tokens belongs to each of them."""
        lengths = np.fromiter((len(self.tokens[i]) for i in array("I", packed)), np.int64)
        starts_char = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        character = np.cumsum(starts_char) - 1
        ends = np.cumsum(lengths)
        return character[ends - lengths], character[ends - 1] + 1


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) with at most `limit` bytes each, or one text; null is empty."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > limit:
            yield start, [t or "" for t in column.slice(start, i - start).to_pylist()]
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, [t or "" for t in column.slice(start).to_pylist()]
    pa.default_memory_pool().release_unused()


_LOADED: dict[tuple, ByteBpe] = {}


def load(source: tuple) -> ByteBpe:
    """source: ("ranks", path, pattern) or ("json", path). One per worker process."""
    if source not in _LOADED:
        make = {"ranks": from_ranks, "json": from_json}[source[0]]
        _LOADED[source] = ByteBpe(*make(*source[1:]))
    return _LOADED[source]


def encode(
    docs: DataFrame,
    source: tuple,
    id_col: str = "doc_id",
    text_col: str = "text",
    offsets: bool = False,
    decoded: bool = False,
) -> DataFrame:
    """doc_id, ids (packed little-endian unsigned 32-bit integers), n_tokens; with offsets also
    starts and ends, the characters each token touches; with decoded the bytes that the ids
    stand for. `source` as in load(); the file must be present on every executor.

    Defined cases: null and empty texts give no ids. Very long texts are cut at safe blanks; a
    run of non-blanks is always encoded whole. Nulls and repeats in id_col are passed on. An empty
    table gives no rows. Other columns are ignored, whatever their names."""
    schema = "doc_id {}, ids binary, n_tokens long".format(docs.schema[id_col].dataType.simpleString())
    if offsets:
        schema += ", starts array<long>, ends array<long>"
    if decoded:
        schema += ", decoded binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(source)
        for batch in batches:
            for start, texts in text_slices(batch.column(1)):
                ids = model.encode(texts)
                columns = {
                    "doc_id": batch.column(0).slice(start, len(texts)),
                    "ids": pa.array(ids, pa.binary()),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                }
                if offsets:
                    spans = [model.spans(t, x) for t, x in zip(texts, ids, strict=True)]
                    for name, k in (("starts", 0), ("ends", 1)):
                        columns[name] = pa.array([s[k] for s in spans], pa.list_(pa.int64()))
                if decoded:
                    columns["decoded"] = pa.array([model.decode(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return small_batches(picked).mapInArrow(run, schema)


def decode(encoded: DataFrame, source: tuple) -> DataFrame:
    """doc_id, decoded (bytes), from the columns doc_id and ids of encode(). Any cut of a text's
    ids can be decoded: bytes are joined before they are read as characters, see as_text()."""
    schema = "doc_id {}, decoded binary".format(encoded.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(source)
        for batch in batches:
            decoded = [None if x is None else model.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "decoded": pa.array(decoded, pa.binary())}
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def as_text(decoded: bytes) -> str:
    """Characters of decoded bytes; one that the cut has split becomes U+FFFD."""
    return decoded.decode("utf-8", errors="replace")
