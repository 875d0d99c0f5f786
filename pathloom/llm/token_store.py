"""Operator 2: token ids as ORC files.

Documents are dealt out by ranges of their id, sorted, encoded and written as ORC: each file is a run of ascending
ids, integers are run-length encoded, stripes carry row indexes (minimum and maximum for each stride) and Bloom
filters on doc_id. A reader splits files by stripes and skips stripes and strides by that metadata.

Null text counts as empty: the document holds the end id alone. A very long text is one row, encoded whole. Repeated ids keep
all their rows, in the order of their texts. An empty table gives an empty result. Rows with a null id come first. Only the
id and text columns are read. Names of special tokens in a text get the library's ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bpe import encoder, vocabulary
from ._shared import scratch, ship

END_ID = 2
BATCH_ROWS = 500
#: The ORC writer's settings.
ORC_OPTIONS = {
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.write.format": "0.12",
    "compression": "zstd",
}
STORED = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, to: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID) -> None:
    """Encode docs and write them to the folder `to`, in ascending order of id over the files' part numbers."""
    ship(docs.sparkSession)
    path = path or vocabulary("byte_bpe_50k.json")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, before = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH_ROWS):  # bounds the ids held at once
                own = batch.slice(first, BATCH_ROWS)
                ids = [enc.encode(t.as_py()) + end for t in own.column(1)]
                ends = np.cumsum([0] + [len(x) // 4 for x in ids])
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                columns = [own.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(ends[:-1] + before), pa.array(np.diff(ends)), lists]
                before += int(ends[-1])
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "start_in_part", "n_tokens", "ids"])

    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = _by_range(plain).sortWithinPartitions("doc_id", "text").mapInArrow(run, STORED)
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(BATCH_ROWS))  # less text at a time between Spark and its workers
    try:
        rows.write.options(**ORC_OPTIONS).orc(to)
    finally:
        conf.set(key, before)


def _by_range(plain: DataFrame) -> DataFrame:
    """plain dealt out by ranges of doc_id, so that part numbers ascend with the ids. Only the ids are read to find the
    ranges; a range partitioner would read the texts a second time."""
    n = int(plain.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(i / n) for i in range(1, n)]) if n > 1 else F.array(F.lit(0.5))
    cuts = plain.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * n))).first()[0] or []
    bounds = F.from_json(F.lit(str(sorted(set(cuts)))), "array<bigint>")
    # How many cuts are not above the id, by halving steps.
    halves = F.array(*[F.lit(1 << k) for k in range(n.bit_length(), -1, -1)])
    on = lambda at, step: (at + step <= F.size(bounds)) & (F.get(bounds, at + step - 1) <= F.col("doc_id"))
    return plain.repartitionById(n, F.aggregate(halves, F.lit(0), lambda at, step: F.when(on(at, step), at + step).otherwise(at)))


def read_tokens(spark: SparkSession, at: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows; doc_ids are looked up by ORC's own indexes and Bloom filters."""
    stored = spark.read.schema(STORED).orc(at)
    return stored if doc_ids is None else stored.where(F.col("doc_id").isin(doc_ids))


def digest(stored: DataFrame) -> DataFrame:
    """Per stored document: doc_id, start over all files, n_tokens, ids_crc32. Only one number per file meets in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            at, raw = lists.offsets.to_numpy(), memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    ship(stored.sparkSession)
    sizes = stored.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("part_tokens").over(order), F.lit(0)).alias("base"))
    rows = stored.mapInArrow(run, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return rows.join(bases, "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = scratch(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), to)
    return digest(read_tokens(spark, to))


QUERIES = {"op2_token_store": op2_token_store}
ORACLES: dict[str, str] = {}
