"""Vectorised text kernels shared by the operators of this subpackage.

Everything here works on Arrow string arrays and numpy buffers, one bounded block of
documents at a time, so that no Python object is made per word.  Words are maximal runs of
ASCII letters, digits and non-ASCII characters, with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _lut() -> tuple[np.ndarray, np.ndarray]:
    byte = np.arange(256)
    word = ((byte >= 48) & (byte <= 57)) | ((byte >= 65) & (byte <= 90)) | ((byte >= 97) & (byte <= 122)) | (byte >= 128)
    lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint8)
    return word, lower


IS_WORD, LOWER = _lut()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; those of usual lengths are kept."""

    def made(size: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = np.full(size, _BASE), np.full(size, _BASE_INV)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)

    if not _powers:
        _powers.append(made(2 * BLOCK_BYTES))
    up, down = _powers[0] if n <= len(_powers[0][0]) else made(n)
    return up[:n], down[:n]


def forget_powers() -> None:
    _powers.clear()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a hash can be used."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PolyHash:
    """Hashes of any substrings of one buffer from prefix sums."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.down[starts])


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = BLOCK_BYTES) -> np.ndarray:
    """Hashes of spans with ascending starts, a bounded stretch of the values at a time (longer only for a longer span)."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, base + limit)))
        top = max(base, int(ends[i:j].max()))
        out[i:j] = PolyHash(values[base:top])(starts[i:j] - base, ends[i:j] - base)
        i = j
    return out


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def doc_blocks(sizes: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of documents of about `limit` bytes; a longer document stands alone."""
    first, n = 0, len(sizes)
    ends = np.cumsum(sizes)
    while first < n:
        base = ends[first - 1] if first else 0
        last = int(np.searchsorted(ends, base + limit, side="right"))
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class Words:
    """The words of a block: byte positions, 64-bit hashes, and `at`, the word offset of each document."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = IS_WORD[raw]
        begins = inside[1:] & ~inside[:-1]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        begins[cuts] = inside[1:][cuts]
        self.starts = np.flatnonzero(begins)
        stops = ~inside[1:] & inside[:-1]
        stops[cuts] = inside[:-1][cuts]
        self.ends = np.flatnonzero(stops)
        self.lower = LOWER[raw]
        self.hashes = span_hashes(self.lower, self.starts, self.ends)
        self.at = np.searchsorted(self.starts, offsets)

    def prefix_hashes(self, n: int) -> np.ndarray:
        """Hashes of the first n bytes of each word."""
        return span_hashes(self.lower, self.starts, np.minimum(self.starts + n, self.ends))

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.at))


def word_blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first document, end, words) for blocks of the array."""
    raw, offsets = text_buffers(texts)
    for first, last in doc_blocks(np.diff(offsets), limit):
        lo, hi = offsets[first], offsets[last]
        yield first, last, Words(raw[lo:hi], offsets[first : last + 1] - lo)


def ragged_sum_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start+1, ... of every run, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by document) of all runs of `width` words; a shorter text, if it has words, is one run."""
    counts = np.diff(words.at)
    runs = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(runs)])
    starts = ragged_sum_index(words.at[:-1], runs)
    ends = np.minimum(starts + width, np.repeat(words.at[1:], runs))
    return span_hashes(words.hashes, starts, ends), at
