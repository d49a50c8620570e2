"""Texts of an Arrow batch as flat byte arrays, and hashes of many byte ranges at once."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 3 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def filled(column: pa.Array) -> pa.Array:
    """A string (or binary) column whose nulls are empty."""
    return pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "") if column.null_count else column


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary column without nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most ``limit`` bytes of ``column``, or one row."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    begin = held = 0
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(n)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def trim() -> None:
    """Hand freed memory back to the system, which Arrow and glibc otherwise keep for the life of the process."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def give_back() -> None:
    """As :func:`trim`, after objects that refer to each other were let go."""
    gc.collect()
    trim()


def handing_back(read: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``read`` for ``mapInArrow``; at a task's end its memory goes back, as Spark keeps idle Python workers beside later stages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from read(batches)
        trim()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_codes(fold_case: bool = False) -> np.ndarray:
    """A random-looking 64-bit code per byte; with ``fold_case`` A-Z share those of a-z."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))
    if fold_case:
        codes[65:91] = codes[97:123]
    return codes


class RangeHash:
    """Hashes of byte ranges of one flat array, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray, codes: np.ndarray):
        n = len(data)
        powers = np.full(n, _MULTIPLIER, np.uint64)
        powers[:1] = 1
        np.multiply.accumulate(powers, out=powers)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes[data] * powers, out=self.sums[1:])
        back = np.full(n + 1, _INVERSE, np.uint64)
        back[:1] = 1
        self.back = np.multiply.accumulate(back)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


#: White space of the word rule: 0x09-0x0D and 0x20.
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[9, 10, 11, 12, 13, 32]] = False


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of ``inside`` bytes; none crosses a text."""
    n = len(inside)
    cuts = offsets[:-1][offsets[:-1] < n]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[cuts] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(offsets, starts, "right") - 1
