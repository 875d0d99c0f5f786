"""Helpers that several operators share: scratch tables, Arrow text access, word hashing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import discard, shared_dir, ship
from ..functions.tables import written as store

__all__ = ["discard", "shared_dir", "ship", "store"]

#: Word separators of the `[^\x20\x09-\x0D]+` definition, as a Java character class.
SPACES = r"[ \t-\r]+"
#: Bytes of text handled at once by the vectorised kernels; bounds their memory.
BLOCK_BYTES = 1 << 20


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pathloom/{name}-{uuid.uuid4().hex}"


def store_observed(df: DataFrame, name: str, **values: Column) -> tuple[DataFrame, dict]:
    """store(), and aggregates over the rows, computed while they are written."""
    seen = Observation()
    table = store(df.observe(seen, *[v.alias(k) for k, v in values.items()]), name)
    return table, seen.get


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind value to a lambda variable, so that body may use it often and it is computed once."""
    return F.transform(F.array(value), body)[0]


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives the memory that it does not use back to the system: workers live on, idle, beside those of later stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # not every C library has it
            pass

    return whole


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_blocks(offsets: np.ndarray, most: int = BLOCK_BYTES):
    """Ranges of rows of about `most` bytes; a longer row is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = last


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = _BYTE[_LOWER]
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_VALUE[~_IS_WORD] = 0
_BASE = int(_rng.integers(1 << 61, 1 << 62)) * 2 + 1
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for key, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(n, base & ((1 << 64) - 1), np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place where possible."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def hashed_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of each row, and the first word of each row (one more entry at the end)."""
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for first, last in row_blocks(offsets):
        at, stop = int(offsets[first]), int(offsets[last])
        own = offsets[first : last + 1]
        while at < stop:
            end = min(stop, at + 2 * BLOCK_BYTES)
            if end < stop:  # only inside one very long row: cut before the last separator
                gaps = np.flatnonzero(~_IS_WORD[raw[at:end]])
                while not len(gaps) and end < stop:
                    end = min(stop, end + 2 * BLOCK_BYTES)
                    gaps = np.flatnonzero(~_IS_WORD[raw[at:end]])
                if end < stop:
                    end = at + int(gaps[-1]) + 1
            piece = raw[at:end]
            n = len(piece)
            up, down = _power_table(max(n, 2 * BLOCK_BYTES))
            word = _IS_WORD[piece]
            edge = np.zeros(n + 1, bool)
            inside = own[(own >= at) & (own < end)] - at
            edge[inside] = True
            before = np.empty(n, bool)
            before[0] = False
            before[1:] = word[:-1]
            starts = np.flatnonzero(word & (~before | edge[:n]))
            edge[n] = True
            after = np.zeros(n, bool)
            after[:-1] = word[1:]
            ends = np.flatnonzero(word & (~after | edge[1:]))
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_VALUE[piece] * up[:n], out=sums[1:])
            hashes.append(mix((sums[ends + 1] - sums[starts]) * down[starts]))
            if last - first == 1:
                counts[first] += len(starts)
            else:
                counts[first:last] += np.diff(np.searchsorted(starts + at, own))
            at = end
    firsts = np.zeros(len(offsets), np.int64)
    np.cumsum(counts, out=firsts[1:])
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), firsts
