"""Words and bytes of Arrow text columns, as numpy arrays: no Python object is made for a word that occurs again."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that a worker holds as Python or numpy objects at a time; one longer text is a slice of its own.
SLICE = 1 << 20
#: Odd multipliers of a 64-bit finaliser, and all bits.
MIX1, MIX2, FULL = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xFFFFFFFFFFFFFFFF)
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each of about ``most`` bytes in ``column``, a row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def released() -> None:
    """Gives back to the system what this worker no longer uses; workers outlive their stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_slices(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text", most: int = SLICE) -> DataFrame:
    """``df.mapInArrow``, with ``f`` called on slices that are bounded in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in slices(batch, column, most):
                    yield f(part)
        finally:
            released()

    return df.mapInArrow(run, schema)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, and where each row starts in them, with the end; null rows are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def coded(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The pieces of ``data`` between ``bounds`` as (code of each piece, distinct pieces)."""
    if len(bounds) < 2:
        return np.zeros(0, np.int64), []
    bounds, data = np.ascontiguousarray(bounds, np.int64), np.ascontiguousarray(data)
    made = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
    return made.indices.to_numpy(), made.dictionary.to_numpy(zero_copy_only=False).tolist()


def places(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start and end of each word, words of each row): words lie between white space [\x20\x09-\x0D], A-Z lowered."""
    data, bounds = flat(column)
    inside = ~_GAP[data]
    start, last = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    some = np.diff(bounds) > 0  # a word ends where its row does
    heads, tails = bounds[:-1][some], bounds[1:][some] - 1
    start[heads], last[tails] = inside[heads], inside[tails]
    starts = np.flatnonzero(start)
    return _LOWER[data], starts, np.flatnonzero(last) + 1, np.diff(np.searchsorted(starts, bounds))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash and bytes of each word, words of each row); eight bytes are mixed at a time, for all words at once."""
    data, starts, ends, rows = places(column)
    data = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place on
    sizes = left = ends - starts
    out, at = mixed(left.astype(np.uint64) * MIX1), np.arange(len(starts))
    while len(at):
        bits = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        out[at] = mixed(out[at] * MIX2 ^ (eight[starts] & (FULL >> (np.uint64(64) - bits))))
        longer = left > 8
        at, starts, left = at[longer], starts[longer] + 8, left[longer] - 8
    return out, sizes, rows
