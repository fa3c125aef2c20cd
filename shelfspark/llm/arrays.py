"""Texts of an Arrow batch as byte arrays, their words, and 64-bit names of strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from shelfspark.llm.common import mix64

_U = np.uint64
# Odd multipliers of the pair names.
_FIRST, _SECOND = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
_BYTE = mix64(np.arange(1, 257, dtype=_U))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of the pair of two names, element by element."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> _U(31))) * _FIRST
        x += b
        x ^= x >> _U(29)
        x *= _SECOND
    x ^= x >> _U(32)
    return x


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column in one array, and where each text starts (one more entry than texts); null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    first, last = (int(starts[0]), int(starts[-1])) if len(starts) else (0, 0)
    return np.frombuffer(data, dtype=np.uint8)[first:last], starts - first


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds at most ``most`` bytes of ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def words(data: np.ndarray, starts: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word: longest stretches, within one text, of bytes that ``blank`` (256 flags) does not mark."""
    inside = ~blank[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[starts] = True
    before = np.empty(len(data), dtype=bool)
    after = np.empty(len(data), dtype=bool)
    if len(data):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
    first = np.flatnonzero(inside & (~before | edge[:-1]))
    last = np.flatnonzero(inside & (~after | edge[1:]))
    return first, last + 1


def word_names(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit names of words that come one after the other in ``data``: equal words have equal names."""
    sizes = end - first
    if not len(sizes):
        return np.zeros(0, dtype=_U)
    # Place of every byte within its word; bytes behind a word's end get no weight.
    start = np.zeros(len(data), dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    start[first] = first
    place = np.arange(len(data), dtype=start.dtype) - np.maximum.accumulate(start)
    longest = int(sizes.max())
    weights = np.zeros(longest + 2, dtype=_U)
    weights[:longest] = mix64(np.arange(longest, dtype=_U) + _U(1 << 40)) | _U(1)
    codes = _BYTE[data]
    # Between words lie other bytes: only those of words count.
    steps = np.zeros(len(data) + 1, dtype=np.int8)
    steps[first] += 1
    np.subtract.at(steps, end, 1)
    codes *= np.cumsum(steps[:-1], dtype=np.int8).astype(bool)
    with np.errstate(over="ignore"):
        codes *= weights[np.minimum(place, longest + 1)]
    return pair(np.add.reduceat(codes, first), sizes.astype(_U))


def row_of(starts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The text that each word belongs to; words in order."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(np.searchsorted(first, starts)))


def signed(names: np.ndarray) -> pa.Array:
    return pa.array(names.view(np.int64))
