"""Hashes of words in numpy arrays, and slices of Arrow batches that bound what is held at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[i] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run ``values[start:end]`` of unsigned 64-bit numbers; it depends on the values and their order."""
    power, inverse = powers(len(values))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values * power[: len(values)], dtype=np.uint64)])
    return mixed((sums[end] - sums[start]) * inverse[start])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, column: int | None = None, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows and, if a string or list ``column`` is named, about ``size`` bytes; a
    longer row stands alone."""
    for batch in batches:
        lo, total = 0, batch.num_rows
        if column is None or not total:
            yield from (batch.slice(i, rows) for i in range(0, total, rows))
            continue
        held = batch.column(column)
        width = 8 if pa.types.is_list(held.type) or pa.types.is_large_list(held.type) else 1
        lengths = pa.compute.binary_length(held) if width == 1 else pa.compute.list_value_length(held)
        ends = np.cumsum(np.asarray(lengths.fill_null(0)).astype(np.int64) * width)
        while lo < total:
            before = int(ends[lo - 1]) if lo else 0
            hi = min(lo + rows, max(lo + 1, int(np.searchsorted(ends, before + size, side="right"))), total)
            yield batch.slice(lo, hi - lo)
            lo = hi
