"""Words, hashes and shingles of whole Arrow batches, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; a longer text goes alone.
SLICE_BYTES = 1 << 20
SHINGLE = 5

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(32))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, UTF-8 bytes, bounds of each row) in slices; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, where, data = column.buffers()
    bounds = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE_BYTES, "right")) - 1)
        yield at, to, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to
    pa.default_memory_pool().release_unused()  # workers live on and share an executor's memory


def words(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the range of its words; ``space`` says which bytes part them."""
    solid = ~space[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:] = ~solid[:-1]
    after[:-1] = ~solid[1:]
    starts = np.flatnonzero(solid & (before | cut[:-1]))
    ends = np.flatnonzero(solid & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    length = ends - starts
    out = mixed(length.astype(np.uint64))
    rest, pos, left = np.arange(len(starts)), starts, length
    while len(rest):
        mask = np.where(left >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.minimum(left, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1))
        out[rest] = mixed(out[rest] + (eight[pos] & mask) * M2)
        more = left > 8
        rest, pos, left = rest[more], pos[more] + 8, left[more] - 8
    return out


def sequence_hash(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` neighbours."""
    n = len(h) - size + 1
    out = np.full(max(n, 0), size, np.uint64)
    for k in range(size):
        out = mixed(out * M1 + h[k : k + n]) if k == size - 1 else out * M1 + h[k : k + n]
    return out


def shingles(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles, A-Z lower-cased.

    A text with fewer words gives its whole sequence as one; one without words gives none.
    """
    for _, _, data, bounds in texts(column):
        data = FOLD[data]
        starts, ends, at = words(data, bounds)
        h = hashes(data, starts, ends)
        runs = sequence_hash(h, size)
        for a, b in zip(at[:-1], at[1:]):
            n = b - a
            if n >= size:
                yield np.unique(runs[a : b - size + 1])
            elif n:
                yield sequence_hash(h[a:b], int(n))
            else:
                yield np.zeros(0, np.uint64)
