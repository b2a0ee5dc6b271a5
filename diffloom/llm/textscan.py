"""Vectorised scanning of Arrow text columns: words, word hashes, shingles.

A word is a longest run of bytes other than the six ASCII white-space
characters (space and 0x09-0x0D); all other bytes, also those of multi-byte
characters, belong to words.  Everything works on the UTF-8 bytes of a whole
column slice at once, so no Python object is made for each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 19
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


LONG = 128  # bytes from which a word is hashed or compared on its own
_U = np.uint64
_KEYS = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros after the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def _chunk(eights: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes at each place, or the `left` ones where a word ends before."""
    got = eights[at].astype(np.uint64)
    keep = _U(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(left, 8)).astype(np.uint64) * _U(8))
    return got & keep


def hash_words(data: np.ndarray, start: np.ndarray, size: np.ndarray, key: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of data; different keys give independent ones.

    Spans are taken eight bytes a step, each step a bijective mix of what came
    before with the next bytes; long ones go through xxHash.
    """
    one, two = _KEYS[2 * key], _KEYS[2 * key + 1]
    h = mix(size.astype(np.uint64) * two + one)
    eights = _eights(data)
    rows, k = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(rows):
        h[rows] = mix((h[rows] ^ _chunk(eights, start[rows] + k, size[rows] - k)) + two)
        k += 8
        rows = rows[size[rows] > k]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + size[i]].tobytes(), int(one))
    return h


def same_words(a: np.ndarray, a_start: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether the spans of a and b hold the same bytes, pair by pair."""
    same = a_size == b_size
    left, right = _eights(a), _eights(b)
    rows, k = np.flatnonzero(same & (a_size > 0) & (a_size <= LONG)), 0
    while len(rows):
        n = a_size[rows] - k
        same[rows] = _chunk(left, a_start[rows] + k, n) == _chunk(right, b_start[rows] + k, n)
        k += 8
        rows = rows[same[rows] & (a_size[rows] > k)]
    for i in np.flatnonzero(same & (a_size > LONG)).tolist():
        same[i] = bool((a[a_start[i] : a_start[i] + a_size[i]] == b[b_start[i] : b_start[i] + b_size[i]]).all())
    return same


@dataclass
class Slice:
    """Words of the rows lo..hi of a column: byte spans into data, and per row the number of words."""

    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray  # byte offset of each row in data, and the end
    start: np.ndarray
    end: np.ndarray
    counts: np.ndarray

    def first_word(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts)])

    def hashes(self, key: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; independent ones for different keys."""
        return hash_words(self.data, self.start, self.end - self.start, key)

    def differing(self, at: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Words that aren't the word their hash stands for: at[back[i]] for word i."""
        size, of = self.end - self.start, at[back]
        return np.flatnonzero(~same_words(self.data, self.start, size, self.data, self.start[of], size[of]))

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind.itemsize).astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of about `limit` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def scan(column: pa.Array, lower: bool = True, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Words of a text column, slice by slice; `lower` maps A-Z to a-z first."""
    data, offsets = buffers(column)
    for lo, hi in row_slices(offsets, limit):
        at = offsets[lo : hi + 1]
        part = data[at[0] : at[-1]]
        part = _LOWER[part] if lower else part
        at = at - at[0]
        inside = ~_WHITE[part]
        fresh = np.zeros(len(part) + 1, bool)
        fresh[at] = True
        before = np.concatenate([[False], inside])[:-1] & ~fresh[:-1]
        after = np.concatenate([inside, [False]])[1:] & ~fresh[1:]
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        counts = np.diff(np.searchsorted(start, at))
        yield Slice(lo, hi, part, at, start, end, counts)


_STEP = mix(np.arange(1, 33, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of a row's word shingles in order, repeats included.

    A row of fewer words than `size` has its whole sequence as one shingle;
    a row without words has none.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    width = min(size, n)
    total = np.full(n - width + 1, np.uint64(width))
    for k in range(width):
        total = total + words[k : n - width + 1 + k] * _STEP[k]
    return mix(total)


def shingle_hashes_of(words: list[np.ndarray]) -> np.ndarray:
    """Hashes of shingles given as columns of word numbers."""
    total = np.zeros(len(words[0]), np.uint64)
    for k, w in enumerate(words):
        total = mix(total + w.astype(np.uint64) * _STEP[k])
    return total
