"""Arrow and numpy helpers for whole texts: byte buffers, words and word hashes.

All helpers work on UTF-8 bytes.  Word separators are ASCII in every operator
here, so a byte table decides what belongs to a word, also within multi-byte
characters.  Batches are cut into slices of a few MB, which bounds the memory of
a task whatever the number of rows in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one slice holds, unless a single text is longer.
SLICE_BYTES = 4 << 20

#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, one text after the other, and len + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    if data is None:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose texts hold ``limit`` bytes at most, or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths.astype(np.int64))
    at, n = 0, batch.num_rows
    while at < n:
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def spans(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray):
    """Start and end byte of every word, and for each text the index of its first word (len + 1 values)."""
    mask = is_word[data]
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    inner = offs[1:-1]
    inner = inner[inner < len(data)]
    begins[inner] = mask[inner]
    stops = mask.copy()
    stops[:-1] &= ~mask[1:]
    inner = inner[inner > 0]
    stops[inner - 1] = mask[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offs)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the entropy of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[0][:n], _powers[1][:n]


class Hasher:
    """64-bit hashes of any byte ranges of one buffer, in constant time each."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash for each word, in blocks so that a very long text needs little more memory than its words."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        end = max(at + 1, int(np.searchsorted(ends, base + block, side="right")))
        h = Hasher(data[base : ends[end - 1]])
        out[at:end] = h(starts[at:end] - base, ends[at:end] - base)
        at = end
    return out


def arrays(values: np.ndarray, offs: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column of the given flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values, kind))


def runs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of given sizes laid end to end: each item's group and its place within it."""
    group = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return group, np.arange(len(group)) - first[group]
