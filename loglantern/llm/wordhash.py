"""Word hashes over Arrow batches of texts, in numpy: one kernel for all word shingles.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D. A batch is worked through in
chunks of about a megabyte, so memory does not follow the batch; one text is always whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_U = np.uint64
_BYTES = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RUN = 4096


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _BASE, np.uint64))


_POWERS = _powers(_RUN)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64 (the splitmix64 finaliser)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@dataclass
class Chunk:
    """Rows ``first`` to ``first + len(counts)`` of a batch: hashes of all their words in
    order, and how many each row has."""

    first: int
    hashes: np.ndarray
    counts: np.ndarray

    @property
    def begins(self) -> np.ndarray:
        return np.cumsum(self.counts) - self.counts

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether all k are of one text."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(k):
                h = h * _BASE + self.hashes[i : i + n]
            h = mix(h)
        left = np.repeat(self.begins + self.counts, self.counts)[:n] - np.arange(n)
        return h, left >= k


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets.astype(np.int64)


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    if not len(column):
        return
    data, offsets = text_bytes(column)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, len(offsets) - 1)
        yield _chunk(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def _chunk(first: int, data: np.ndarray, offsets: np.ndarray) -> Chunk:
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~_IS_SPACE[data]
    edges = np.flatnonzero(word[1:] != word[:-1])  # starts and ends by turns
    inner = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    torn = inner[word[inner] & word[inner + 1]]  # a text ends in a word where the next begins with one
    if len(torn):
        edges = np.sort(np.concatenate([edges, torn, torn]))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return Chunk(first, np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64))
    lengths = ends - starts
    values = _BYTES[data[word[1:-1]]]
    begins = np.cumsum(lengths) - lengths
    place = np.arange(len(values)) - np.repeat(begins, lengths)
    with np.errstate(over="ignore"):
        values = values * _POWERS[place % _RUN if lengths.max() > _RUN else place]
        if lengths.max() > _RUN:
            values = mix(values + (place // _RUN).astype(np.uint64))
        hashes = mix(np.add.reduceat(values, begins) + lengths.astype(np.uint64))
    counts = np.diff(np.searchsorted(starts, offsets))
    return Chunk(first, hashes, counts)
