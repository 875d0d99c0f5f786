"""Operator 7: pack tokenised documents into windows by best-fit decreasing.

A document's ids (and one end id) are first cut into full windows; the rests go, longest first, into the
tightest open window that still has room, which a segment tree over remaining capacities finds. Input is
packed in blocks of a bounded number of tokens inside each task, so nothing is shuffled and no task holds more
than a block; a block leaves at most a few windows short. Many small partitions are first read together, so that each task
has `task_bytes` of text or more and padding does not depend on how the input is cut into files.

Names of special tokens in a text get the library's ids. Ties in length go to the earlier document of the block. Null text counts as empty: such a document is its end id alone. Repeated rows are packed as often as they occur.
An empty table gives an empty result. Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bpe import encoder, vocabulary
from ._shared import giving_back, ship

WINDOW = 1024
END_ID = 0
BLOCK_TOKENS = 4_000_000
TASK_BYTES = 4 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Open windows by remaining capacity 1..size; take(n) removes one of the smallest capacity >= n."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.full = [0] * (2 * self.leaves)  # windows below each node
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.full[node] += by
            node >>= 1

    def put(self, window: int, capacity: int) -> None:
        if capacity:
            self.open[capacity].append(window)
            self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(window, its capacity), or None if no open window has room."""
        full, node = self.full, least + self.leaves
        if not full[node]:
            while node > 1 and (node & 1 or not full[node + 1]):  # climb until a right neighbour has windows
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not full[node]:
                    node += 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return self.open[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int], int]:
    """Window and offset of each item (1..window tokens), and the number of windows."""
    tree, where, offset, windows = CapacityTree(window), [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        n = lengths[i]
        got = tree.take(n)
        if got is None:
            got = windows, window
            windows += 1
        where[i], offset[i] = got[0], window - got[1]
        tree.put(got[0], got[1] - n)
    return where, offset, windows


def _pack_block(docs: list[tuple], first_sequence: int, window: int) -> tuple[list[tuple], int]:
    """Pieces of a block of (doc_id, ids as bytes) and the next free sequence id."""
    rows, rests, sequence = [], [], first_sequence
    for doc_id, ids in docs:
        n = len(ids) // 4
        for start in range(0, n - n % window, window):
            rows.append((doc_id, start, window, zlib.crc32(ids[4 * start : 4 * (start + window)]), n, sequence, 0))
            sequence += 1
        if n % window:
            rests.append((doc_id, n - n % window, ids[4 * (n - n % window) :], n))
    where, offset, windows = best_fit_decreasing([len(r[2]) // 4 for r in rests], window)
    for (doc_id, start, ids, n), w, o in zip(rests, where, offset, strict=True):
        rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), n, sequence + w, o))
    return rows, sequence + windows


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, task_bytes: int = TASK_BYTES) -> DataFrame:
    """One row per piece (SCHEMA). Sequence ids are unique over the table and ascend inside a task."""
    ship(docs.sparkSession)
    path = path or vocabulary("byte_bpe_50k.json")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sequence = encoder(path), TaskContext.get().partitionId() << 36
        held, size = [], 0

        def flush():
            nonlocal held, size, sequence
            rows, sequence = _pack_block(held, sequence, window)
            held, size = [], 0
            for i in range(0, len(rows), 50_000):
                columns = zip(*rows[i : i + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(text.as_py()) + end
                held.append((doc_id, ids))
                size += len(ids) // 4
                if size >= block_tokens:
                    yield from flush()
        if held:
            yield from flush()

    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    total = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return plain.coalesce(max(1, total // task_bytes)).mapInArrow(giving_back(run), SCHEMA)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_packing": op7_packing}
ORACLES: dict[str, str] = {}
