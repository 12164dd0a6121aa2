"""Sets of word shingles as 64-bit hashes, a batch of texts at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Fixed odd multipliers of the hashes.
_BASE = 0x9E3779B97F4A7C15
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0xD6E8FEB86659FD93)

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_ANY_BLANK = re.compile(rb"[\x20\x09-\x0d]")
#: Bytes that are hashed at once, unless one word is longer.
PART_BYTES = 1 << 20
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base % (1 << 64), np.uint64)
        steps[0] = 1
        _POWERS[name] = have = np.multiply.accumulate(steps)
        if size > 1 << 24:  # only for this text
            del _POWERS[name]
    return have


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word; words are what blanks (space, 9 to 13) leave between.

    Long data is cut at blanks, so that memory beyond it is for the words only."""
    if len(data) <= 2 * PART_BYTES:
        return _part_hashes(data)
    found, start = [], 0
    while start < len(data):
        blank = _ANY_BLANK.search(data, start + PART_BYTES)
        end = blank.start() if blank else len(data)
        hashes, first = _part_hashes(data[start:end])
        found.append((hashes, first + start))
        start = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _part_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    word = np.concatenate(([False], ~_BLANK[raw], [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    first, end = edges[::2], edges[1::2]
    powers = _powers("up", _BASE, len(raw) + 1)
    down = _powers("down", pow(_BASE, -1, 1 << 64), len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64)), first


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of so many words, A-Z lower-cased; a
    shorter text is one shingle, one without words has none."""
    data = b" ".join(texts).lower()
    hashes, first = word_hashes(data)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    bounds = np.searchsorted(first, starts)
    rolled = mix(hashes + np.uint64(words))
    for j in range(1, words):
        rolled = mix(rolled[: len(rolled) - 1] * _STEP + hashes[j:])[: max(0, len(hashes) - j)]
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            own = np.sort(rolled[a : b - words + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif b > a:
            one = mix(hashes[a : a + 1] + np.uint64(b - a))
            for j in range(a + 1, b):
                one = mix(one * _STEP + hashes[j : j + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def byte_slices(column: pa.Array, limit: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts in UTF-8) with at most `limit` bytes each, or one text; null is empty."""
    column = column.cast(pa.binary())
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield start, [t or b"" for t in column.slice(start, i - start).to_pylist()]
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, [t or b"" for t in column.slice(start).to_pylist()]
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
