"""Words of Arrow text columns as numpy arrays, shared by the word-based operators.

A word is a maximal run of digits, letters and non-ASCII characters after A-Z are
lower-cased. In UTF-8 every byte of a non-ASCII character is 0x80 or more, so the
words can be found on bytes. Texts are handled whole, a few MB at a time; memory is
proportional to the largest of that and the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20

_BYTES = np.arange(256, dtype=np.int64)
_IS_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
LOWER = np.where(_IS_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
IS_WORD = (
    ((_BYTES >= 0x30) & (_BYTES <= 0x39))
    | _IS_UPPER
    | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
    | (_BYTES >= 0x80)
)

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers_of(base: int):
    """A function giving base**0 ... base**(n-1) modulo 2**64; it keeps what it has made."""
    kept = np.ones(1, np.uint64)

    def powers(n: int) -> np.ndarray:
        nonlocal kept
        while len(kept) < n:
            step = np.uint64(pow(base, len(kept), 1 << 64))
            kept = np.concatenate([kept, kept * step])
        return kept[:n]

    return powers


_power = _powers_of(_BASE)
_inverse_power = _powers_of(_INVERSE)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of values[start:end] for every pair, independent of where the range lies."""
    if seed:
        values = mix(values + np.uint64(seed))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(len(values)), out=sums[1:])
    inverse = _inverse_power(len(values) + 1)
    length = (end - start).astype(np.uint64)
    return mix((sums[end] - sums[start]) * inverse[start] + length * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """Words of a few texts: ``data[start[i]:end[i]]``; text t has words first[t] .. first[t+1]-1.

    ``at`` holds the byte where every text begins, and the end of the last.
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        """Number of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def spelled(self, i: int) -> bytes:
        return LOWER[self.data[self.start[i]:self.end[i]]].tobytes()


def _bytes_and_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)), at


def words_of_bytes(data: np.ndarray, at: np.ndarray) -> Words:
    """Words of the texts data[at[t]:at[t+1]]; at[0] must be 0."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return Words(data, empty, empty, np.zeros(len(at), np.int64), np.zeros(0, np.uint64), at)
    inside = IS_WORD[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    borders = at[(at > 0) & (at < n)]
    starts[borders] = inside[borders]
    ends[borders - 1] = inside[borders - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * _power(n), out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * _inverse_power(n)[start])
    return Words(data, start, end, np.searchsorted(start, at), hashes, at)


def word_pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) for runs of rows of about ``limit`` bytes."""
    data, at = _bytes_and_offsets(column)
    row, rows = 0, len(column)
    while row < rows:
        last = int(np.searchsorted(at, at[row] + limit, side="right")) - 1
        last = min(max(last, row + 1), rows)
        yield row, last, words_of_bytes(data[at[row]:at[last]], at[row:last + 1] - at[row])
        row = last


def shingle_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every shingle of ``width`` words; a shorter text is one shingle."""
    counts = np.diff(words.first)
    per_text = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    text = np.repeat(np.arange(len(counts)), per_text)
    before = np.cumsum(per_text) - per_text
    start = words.first[:-1][text] + np.arange(len(text)) - before[text]
    end = start + np.minimum(width, counts[text])
    return range_hash(words.hash, start, end), text
