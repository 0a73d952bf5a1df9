"""Words of Arrow text columns as NumPy arrays: places, 64-bit hashes and window hashes.

A batch of texts is one byte buffer; words are ranges in it. Everything here works on whole arrays and
holds a few numbers per word and one or two bytes per byte of text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: White space of the word rule: space and the six controls from tab to carriage return.
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 18


@dataclass
class Words:
    """Words ``data[starts[i]:ends[i]]``; those of text ``t`` are ``first[t]`` to ``first[t + 1] - 1``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def text_of(self) -> np.ndarray:
        """The text number of every word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_buffer(texts) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column (null read as empty) and the offsets of its texts in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):  # a column without chunks
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(texts, lower: bool = False, is_word: np.ndarray = _IS_WORD) -> Words:
    """Words of every text; ``lower`` turns A-Z into a-z first."""
    data, offsets = text_buffer(texts)
    if lower:
        data = _LOWER[data]
    inside = is_word[data]
    nonempty = offsets[:-1] < offsets[1:]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[offsets[:-1][nonempty]] = False
    starts = np.flatnonzero(inside & ~before)
    before[:-1] = inside[1:]
    before[offsets[1:][nonempty] - 1] = False
    ends = np.flatnonzero(inside & ~before) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def _powers(n: int) -> np.ndarray:
    powers = np.full(n, _BASE, dtype=np.uint64)
    powers[:1] = 1
    return np.multiply.accumulate(powers)


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every nonempty byte range: a polynomial in a fixed odd base, scrambled."""
    lengths = ends - starts
    hashes = np.empty(len(starts), dtype=np.uint64)
    powers = _powers(int(lengths.max(initial=0)))
    total = np.concatenate(([0], np.cumsum(lengths)))
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(total, total[low] + _BLOCK, side="right")) - 1)
        n, at = lengths[low:high], total[low:high] - total[low]
        within = np.arange(int(total[high] - total[low])) - np.repeat(at, n)
        values = data[np.repeat(starts[low:high], n) + within].astype(np.uint64) + np.uint64(1)
        values *= powers[within]
        hashes[low:high] = np.add.reduceat(values, at)
        low = high
    return mix(hashes + lengths.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def hash_words(words: Words) -> np.ndarray:
    return hash_ranges(words.data, words.starts, words.ends)


def window_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start places and hashes of all windows of ``width`` consecutive items that lie in one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    counts = np.maximum(np.diff(first) - width + 1, 0)
    ends = np.cumsum(counts)
    places = np.arange(int(ends[-1])) + np.repeat(first[:-1] - (ends - counts), counts)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    combined = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        combined += hashes[k : k + n] * factors[k]
    return places, mix(combined[places])
