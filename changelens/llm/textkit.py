"""Vectorised work on the UTF-8 buffers of Arrow string columns; small helpers for tasks, no state between them."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; a longer text is handled alone.
CHUNK = 1 << 18
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, their bytes, offsets into these); null counts as empty."""
    column = pc.fill_null(column.cast(pa.string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    while len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            have = _powers[k]
            _powers[k] = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    return _powers[0][:n], _powers[1][:n]


def hash_sums(symbols: np.ndarray) -> np.ndarray:
    """Running sums from which ``range_hashes`` takes the hashes of ranges."""
    sums = np.zeros(len(symbols) + 1, np.uint64)
    up, _ = powers(len(symbols) + 1)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return sums


def range_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of symbols[start:end] for each range, equal for equal content wherever it stands; ``sums`` are its hash_sums, if known."""
    sums = hash_sums(symbols) if sums is None else sums
    _, down = powers(len(symbols) + 1)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of non-blank bytes."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = ~BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, ~solid[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, ~solid[1:]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def by_row(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows begins and ends in a sorted array of row numbers."""
    return np.searchsorted(rows, np.arange(n + 1))


def tidy(run: Callable) -> Callable:
    """``run`` over batches of one task, after which the worker's unused memory goes back to the machine.

    Workers are kept for later tasks; without this each would hold on to the most that any of its tasks needed.
    """

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return done
