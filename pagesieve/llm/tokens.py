"""Words, word hashes and n-gram hashes of whole Arrow string columns, vectorised over bytes.

A word is a maximal run of word bytes.  Both word definitions used here are
unions of byte classes of UTF-8 (every non-ASCII character is a word character),
so no decoding is needed.  Hashes are 64-bit: a random value per byte, weighted
by position, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTE = np.arange(256)
NOT_BLANK = ~((_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D)))
LETTERS_DIGITS = (_BYTE >= 0x80) | ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A))
LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint8)

_RANDOM = np.random.default_rng(20240607)
_BYTE_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_GRAM_WEIGHT = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all input bits over the output (xor-shift, multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some rows: ``offsets[i]:offsets[i + 1]`` are the words of row ``first + i``."""

    first: int
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    row_starts: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``k`` consecutive words by first word, and whether all ``k`` are of one row."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(n, np.uint64), np.zeros(n, bool)
        with np.errstate(over="ignore"):
            total = np.full(n - k + 1, np.uint64(k) * _BASE)
            for j in range(k):
                total += self.hashes[j : n - k + 1 + j] * _GRAM_WEIGHT[j]
        full = np.zeros(n, np.uint64)
        full[: n - k + 1] = mix(total)
        left = np.repeat(self.offsets[1:], self.counts) - np.arange(n)
        return full, left >= k

    def whole(self, row: int) -> np.uint64:
        """Hash of the whole word sequence of a row of fewer than 64 words, unlike any longer n-gram."""
        own = self.hashes[self.offsets[row] : self.offsets[row + 1]]
        with np.errstate(over="ignore"):
            return mix(np.array([np.uint64(len(own)) * _BASE + (own * _GRAM_WEIGHT[: len(own)]).sum(dtype=np.uint64)]))[0]


def _text_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset :][: len(column) + 1]
    data = column.buffers()[2]
    return offsets.astype(np.int64), np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def byte_slices(batches: Iterable[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in smaller ones of some bytes of text in column ``at`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets, _ = _text_parts(batch.column(at))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
            last = min(last, batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def words(column: pa.Array, is_word: np.ndarray, lower: bool = True) -> Iterator[Words]:
    """Words of every row (null: none), in slices of whole rows that bound the scratch memory."""
    if not len(column):
        return
    offsets, data = _text_parts(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        last = min(last, len(column))
        part = data[offsets[first] : offsets[last]]
        yield _words(first, part, offsets[first : last + 1] - offsets[first], is_word, lower)
        first = last


def _words(first: int, data: np.ndarray, rows: np.ndarray, is_word: np.ndarray, lower: bool) -> Words:
    if lower:
        data = LOWER[data]
    inside = is_word[data]
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, inside
    before[rows[:-1]] = False
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[rows[1:]] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    sizes = ends - starts
    offsets = np.searchsorted(starts, rows)
    if len(starts):
        at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        place = np.arange(int(sizes.sum())) - np.repeat(at, sizes)
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(np.full(int(sizes.max()), _BASE))
            hashes = mix(np.add.reduceat(_BYTE_VALUE[data[inside]] * power[place], at) + sizes.astype(np.uint64)) | np.uint64(1)
    else:
        hashes = np.zeros(0, np.uint64)
    return Words(first, offsets, starts, ends, data, rows, hashes)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
