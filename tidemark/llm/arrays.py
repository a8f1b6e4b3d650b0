"""Texts of an Arrow batch as flat numpy arrays: bytes, words, hashes of runs of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ROWS = 64
_rng = np.random.Generator(np.random.PCG64(20240607))
#: A random number for each byte at each place of a word (tabulation hashing).
_TABLE = _rng.integers(0, 2**64, size=(_ROWS, 256), dtype=np.uint64)
_STEPS = _rng.integers(0, 2**64, size=128, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the texts reach `limit` bytes, so memory doesn't depend on rows per batch."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float))
    bounds, start, total = [], 0, 0.0
    for i, n in enumerate(sizes):
        total += n
        if total >= limit:
            bounds.append((start, i + 1))
            start, total = i + 1, 0.0
    if start < len(sizes):
        bounds.append((start, len(sizes)))
    for a, b in bounds:
        yield batch.slice(a, b - a)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and n + 1 bounds.  Null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(at) == 0 or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """Words of several texts: byte bounds, hash, the text each is in, and its place there."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    text: np.ndarray
    first: np.ndarray  # n + 1 bounds of each text's words

    @property
    def place(self) -> np.ndarray:
        return np.arange(len(self.text), dtype=np.int64) - self.first[self.text]

    def runs(self, k: int, salt: int = 0, at: np.ndarray | None = None) -> np.ndarray:
        """Hash of the k words from each word on, or from those in `at`; runs past the end of a text are rubbish."""
        n = max(0, len(self.hash) - k + 1)
        out = np.zeros(n if at is None else len(at), np.uint64)
        for j in range(k):
            out += (self.hash[j : j + n] if at is None else self.hash[at + j]) * _STEPS[(salt + j) % 128]
        return mix(out)

    def whole(self, k: int) -> np.ndarray:
        """Does the run of k words from each word on stay inside its text?"""
        n = max(0, len(self.text) - k + 1)
        return self.text[:n] == self.text[k - 1 : k - 1 + n]


def words(data: np.ndarray, bounds: np.ndarray) -> Words:
    space = SPACE[data]
    gap = np.empty(len(data) + 1, bool)  # is the place before byte i outside any word that goes on at i?
    gap[0] = gap[-1] = True
    gap[1:-1] = space[:-1]
    gap[bounds] = True
    start = np.flatnonzero(gap[:-1] & ~space)
    after = np.empty(len(data), bool)
    if len(data):
        after[:-1] = space[1:]
        after[-1] = True
        after[bounds[(bounds > 0)] - 1] = True
    end = np.flatnonzero(after & ~space) + 1
    inside = np.flatnonzero(~space)
    size = end - start
    head = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=head[1:])
    if len(start):
        place = np.arange(len(inside), dtype=np.int64) - np.repeat(head[:-1], size)
        value = _TABLE[place & (_ROWS - 1), data[inside]]
        far = np.flatnonzero(place >= _ROWS)  # shorter words hash alike whatever else the batch holds
        value[far] *= mix((place[far] // _ROWS).astype(np.uint64) + np.uint64(1)) | np.uint64(1)
        hashes = mix(np.add.reduceat(value, head[:-1]) + size.astype(np.uint64))
    else:
        hashes = np.zeros(0, np.uint64)
    first = np.searchsorted(start, bounds)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Words(start, end, hashes, text, first)
