"""Hashes of words and word shingles for a batch of texts, in numpy over their UTF-8 bytes.

A word is a run of bytes other than ASCII white space. Its hash is a polynomial over random
values of its bytes, taken from running sums, so that no Python code runs for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RANDOM = np.random.default_rng(0x5EED)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_POWER = 0x9E3779B97F4A7C15
_INVERSE = pow(_POWER, -1, 1 << 64)
#: Texts are hashed in chunks of about so many bytes, to bound the memory of a task.
CHUNK = 1 << 20


def text_chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, bytes and row offsets of chunks of whole texts; nulls are empty.

    A chunk ends at the first row that brings it to ``most`` bytes, so a longer text makes a
    chunk of its own size.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + most, side="left"))
        last = min(max(last, first + 1), len(texts))
        own = offsets[first : last + 1]
        yield first, last, data[own[0] : own[-1]], own - own[0]
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each row (with the end)."""
    inside = ~SPACE[data]
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """``h`` (uint64) with its bits spread over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_long(keys: np.ndarray) -> np.ndarray:
    """What Spark's ``hash`` gives for whole numbers of 64 bits."""
    bits = keys.view(np.uint64)
    h = np.full(len(bits), 42, np.uint32)
    for half in (bits.astype(np.uint32), (bits >> np.uint64(32)).astype(np.uint32)):
        h = _turned(h ^ _turned(half * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593), 13)
        h = h * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def _turned(h: np.ndarray, by: int) -> np.ndarray:
    return (h << np.uint32(by)) | (h >> np.uint32(32 - by))


def _powers(of: int, n: int) -> np.ndarray:
    steps = np.full(n, of, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


class WordHasher:
    """Word hashes of chunks; keeps the powers that it has computed."""

    def __init__(self) -> None:
        self._up = self._down = np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self._up) <= len(data):
            self._up = _powers(_POWER, len(data) + 1)
            self._down = _powers(_INVERSE, len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self._up[: len(data)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self._down[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, rows: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of each row, and each row's first (with the end).

    ``rows`` has the first word of each row and the end. A row with fewer words has one
    shingle, of all its words; a row without words has none.
    """
    counts = np.diff(rows)
    kept = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    firsts = np.concatenate([[0], np.cumsum(kept)])
    at = np.repeat(rows[:-1] - firsts[:-1], kept) + np.arange(firsts[-1])
    left = np.minimum(np.repeat(rows[1:], kept) - at, size)
    hashes = np.zeros(len(at), np.uint64)
    for j, factor in enumerate(_powers(_POWER ^ 0xABCDEF01, size + 1)[1:]):
        present = left > j
        if present.all():
            hashes += words[at + j] * factor
        else:
            hashes[present] += words[at[present] + j] * factor
    return mixed(hashes + left.astype(np.uint64)), firsts


def minhashes(
    hashes: np.ndarray,
    firsts: np.ndarray,
    functions: int,
    seed: int = 4,
    only: np.ndarray | None = None,
) -> np.ndarray:
    """One row of ``functions`` minima, or of those numbered ``only``, for each row with shingles."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 63, functions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    masks = rng.integers(0, 1 << 63, functions, dtype=np.uint64)
    starts = firsts[:-1][np.diff(firsts) > 0]
    chosen = range(functions) if only is None else only.tolist()
    out = np.empty((len(starts), len(chosen)), np.uint64)
    for place, k in enumerate(chosen):
        out[:, place] = np.minimum.reduceat((hashes ^ masks[k]) * factors[k], starts)
    return out
