"""Operator 9: language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs over the training documents are quantised to levels (exact up to 4, then steps of about
1.4); an n-gram of level q is inserted q times, as (n-gram, 1) .. (n-gram, q), into one Bloom filter. A reader probes levels
upwards until one is missing. Every n-gram is in it, at 10 bits an entry, so it grows with the corpus. It is a table of slices by
key range, more of them for more text, so that none takes over about `filter_bytes` bytes. Texts go through in chunks: each sends its
distinct keys, with how often training documents of the chunk have them, to their slices; the task of a slice sums the counts, fills the slice
and tells each chunk the levels of its keys, so that a worker holds one slice at a time, the driver none, and keys go over the network once.

The probability of a word after another is lam * c(pair) / c(first) + (1 - lam) * (c(word) + 1) / (N + V + 1), all counts
by probes (lam only where the first was seen); the text's start counts as after an end.

The base score needs each token's exact count. The at most `head` most frequent words are broadcast, and so their levels need no probe; all other occurrences are
joined with the counts by word hash, so nothing grows on the driver and no key is hot. Words and pairs are told apart by 64-bit hashes.

Training documents: crc32 of the id as text, modulo 7, is not 2 (a null id trains). Null and empty texts are an end alone; a very long
text is a chunk of its own. Words of equal count at the head's edge are all in the head or all out of it.
Repeated rows train and are scored each. An empty table gives an empty result; with no training document N = V = 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import hashed_words, mix, row_blocks, ship, store, text_buffers

#: Bytes of one slice of the filter, about.
FILTER_BYTES = 32 << 20
BITS_PER_ENTRY = 10
PROBES = 4
HEAD = 200_000
LAM = 0.4
SLICES = 64
#: Text that is counted, and that is scored, at once; bounds on a worker's memory.
CHUNK_BYTES = 8 << 20
SCORE_BYTES = 3 << 20
#: How hard chunks are compressed; they are written once and sent once.
CHUNK_LEVEL = 6
#: Pairs that one slice merges, about, and text for each of them; bounds on a worker's memory.
PAIRS_PER_BUCKET = 4_000_000
BYTES_PER_TOKEN = 6
#: Small texts have fewer than SLICES slices of about so many tokens; tiny filters give more false positives.
LEAST_PER_SLICE = 1 << 16
END = np.uint64(0x51ED270B9F3C2A11)
_levels = [1, 2, 3, 4]
while _levels[-1] < 1 << 50:
    _levels.append(int(_levels[-1] * 1.4) + 1)
LEVELS = np.array(_levels, np.int64)
#: The count that a level stands for; level 0 is 0.
MEANS = np.concatenate([[0.0], np.sqrt(LEVELS[:-1] * (LEVELS[1:] - 1.0))])


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, counts, "right").astype(np.uint8)


def word_keys(words: np.ndarray) -> np.ndarray:
    return mix(words ^ np.uint64(0xA0761D6478BD642F))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0xE7037ED1A0B428DB) + second * np.uint64(0x8EBC6AF09C88C6E3))


#: Slices are ranges of the keys' first bits; places inside a slice are by all 64.
_TOP, _REST = np.uint64(40), np.uint64(24)


def slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    return (keys >> _REST) * np.uint64(slices) >> _TOP


class CountFilter:
    """64-bit keys with levels, in slices by key range."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits  # uint8, slices x bytes per slice
        self.flat, self.slices, self.width = bits.ravel(), np.uint64(bits.shape[0]), np.uint64(8 * bits.shape[1])

    @classmethod
    def empty(cls, slice_bytes: int, slices: int = SLICES) -> CountFilter:
        return cls(np.zeros((slices, slice_bytes), np.uint8))

    def _places(self, keys: np.ndarray, level: np.ndarray | int) -> Iterator[np.ndarray]:
        h = mix(keys * np.uint64(0x9FB21C651E98DF25) + np.asarray(level).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        low, step = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
        base = slice_of(keys, int(self.slices)) * self.width
        for i in range(PROBES):
            yield base + (low + np.uint64(i) * step) % self.width

    def add(self, keys: np.ndarray, levels: np.ndarray) -> None:
        for j in range(1, int(levels.max(initial=0)) + 1):
            own = keys[levels >= j]
            for at in self._places(own, j):
                np.bitwise_or.at(self.flat, at >> np.uint64(3), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        found, live, j = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 0
        while len(live) and j < len(LEVELS):
            j += 1
            own = keys[live]
            hit = np.ones(len(live), bool)
            for at in self._places(own, j):
                hit &= (self.flat[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
            live = live[hit]
            found[live] = j
        return found


def _squeeze(values: np.ndarray) -> bytes:
    """Unsigned 64-bit integers by byte planes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unsqueeze(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()


def _counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each occurs (or the sum of its weights)."""
    order = np.argsort(keys, kind="stable") if weights is not None else None
    keys = np.sort(keys) if order is None else keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys))) if order is None else np.add.reduceat(weights[order], first) if len(keys) else np.zeros(0, np.int64)
    return keys[first], counts.astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, word hashes, firsts) of parts of batches (id, text)."""
    for batch in batches:
        raw, offsets = text_buffers(batch.column(1))
        for first, last in row_blocks(offsets, most):
            at = offsets[first : last + 1]
            yield batch.column(0).slice(first, last - first), *hashed_words(raw[at[0] : at[-1]], at - at[0])


def _with_ends(words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's words and its end, and the first of each row."""
    starts = firsts + np.arange(len(firsts))
    tokens = np.empty(starts[-1], np.uint64)
    tokens[starts[1:] - 1] = END
    inner = np.ones(len(tokens), bool)
    inner[starts[1:] - 1] = False
    tokens[inner] = words
    return tokens, starts


def _before(tokens: np.ndarray) -> np.ndarray:
    """The token before each; before a row's first stands an end."""
    return np.concatenate([[END], tokens[:-1]]).astype(np.uint64)


def word_counts(train: DataFrame) -> DataFrame:
    """(h, c): exact counts of the tokens of train (id, text), ends included."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, firsts in _chunks(batches):
            keys, counts = _counted(_with_ends(words, firsts)[0])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["h", "n"])

    return train.mapInArrow(work, "h long, n long").groupBy("h").agg(F.sum("n").alias("c"))


def _packed(keys: np.ndarray, slices: int) -> list[tuple[int, int, int, bytes]]:
    """(slice, first, last, packed keys) of ascending keys, for each slice that has any."""
    edges = ((np.arange(slices, dtype=np.uint64) << _TOP) + np.uint64(slices - 1)) // np.uint64(slices) << _REST
    at = [*np.searchsorted(keys, edges).tolist(), len(keys)]
    return [(s, i, j, _squeeze(np.diff(keys[i:j], prepend=np.uint64(0)))) for s, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_unsqueeze(data), dtype=np.uint64)


def text_chunks(plain: DataFrame) -> DataFrame:
    """(cid, docs): rows (id, text) of plain in parts of bounded text size, as compressed Arrow data. cid is the number of the part's first row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for first, last in row_blocks(text_buffers(batch.column(1))[1], SCORE_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=CHUNK_LEVEL))) as out:
                    out.write_batch(batch.slice(first, last - first))
                yield pa.RecordBatch.from_arrays([pa.array([cid]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["cid", "docs"])
                cid += last - first

    return plain.mapInArrow(work, "cid long, docs binary")


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the place of each key among them."""
    order = np.argsort(keys)
    ascending = keys[order]
    first = np.ones(len(keys), bool)
    np.not_equal(ascending[1:], ascending[:-1], out=first[1:])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(first) - 1
    return ascending[first], place


@dataclass(frozen=True)
class Head:
    """The most frequent words: ascending hashes and exact counts."""

    words: np.ndarray
    counts: np.ndarray

    def counts_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are among these, and the counts (0 of others)."""
        if not len(self.words):
            return np.zeros(len(words), bool), np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        inside = self.words[at] == words
        return inside, np.where(inside, self.counts[at], 0)


@dataclass(frozen=True)
class _Chunk:
    """Tokens of a chunk: ids of its rows, tokens and the first of each row, distinct tokens and where each token is among them, which of these the
    head has and how often. Its keys to ask for: of the other distinct tokens, and of the pair at each token; `place` is where those are."""

    ids: pa.Array
    tokens: np.ndarray
    starts: np.ndarray
    own: np.ndarray
    back: np.ndarray
    in_head: np.ndarray
    exact: np.ndarray
    keys: np.ndarray
    place: np.ndarray

    @classmethod
    def read(cls, docs: bytes, head: Head) -> _Chunk:
        batch = pa.ipc.open_stream(docs).read_next_batch()
        tokens, starts = _with_ends(*hashed_words(*text_buffers(batch.column(1))))
        own, back = _distinct(tokens)
        in_head, exact = head.counts_of(own)
        keys, place = _distinct(np.concatenate([word_keys(own[~in_head]), pair_keys(_before(tokens), tokens)]))
        return cls(batch.column(0), tokens, starts, own, back, in_head, exact, keys, place)

    @property
    def pairs(self) -> np.ndarray:
        return self.place[len(self.place) - len(self.tokens) :]

    def counts(self, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts that the levels of the keys stand for: of each distinct token, and of the pair at each token."""
        single = level_of(self.exact)
        single[~self.in_head] = levels[self.place[: len(self.place) - len(self.tokens)]]
        return MEANS[single], MEANS[levels[self.pairs]]


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def asked_keys(chunks: DataFrame, counts: DataFrame, slices: int, head) -> DataFrame:
    """(cid, slice, keys, counts): each chunk's keys (head: a broadcast Head, whose words are known), with the pairs' counts over its training documents; and, of no chunk (cid null), the words' counts."""
    names = ["cid", "slice", "keys", "counts"]

    def rows(cid: int | None, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        own = _packed(keys, slices)
        return pa.RecordBatch.from_arrays([pa.array([cid] * len(own), pa.int64()), pa.array([r[0] for r in own], pa.int32()), pa.array([r[3] for r in own], pa.binary()), pa.array([_squeeze(counts[i:j]) for _, i, j, _ in own], pa.binary())], names=names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, docs in zip(batch.column(0), batch.column(1), strict=True):
                c = _Chunk.read(docs.as_py(), head.value)
                trains = np.repeat([not is_held_out(i) for i in c.ids.to_pylist()], np.diff(c.starts))
                yield rows(cid.as_py(), c.keys, np.bincount(c.pairs[trains], minlength=len(c.keys)))

    def deal_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = word_keys(batch.column(0).to_numpy().view(np.uint64))
            order = np.argsort(keys)
            yield rows(None, keys[order], batch.column(1).to_numpy()[order])

    shape = "cid long, slice int, keys binary, counts binary"
    return chunks.mapInArrow(ask, shape).unionByName(counts.select("h", "c").mapInArrow(deal_words, shape))


def probed_levels(asked: DataFrame) -> DataFrame:
    """(cid, slice, levels): the levels of each chunk's keys; and of each slice one row without cid, the filter's bits."""

    def answer(group: pa.Table) -> pa.Table:
        keys = [_unpacked(k.as_py()) for k in group["keys"]]
        # Pair counts are parts of sums, word counts are whole; keys of the two kinds are hashed apart.
        counts = np.concatenate([_unsqueeze(c.as_py()) for c in group["counts"]]).astype(np.int64)
        some = np.concatenate(keys)[counts > 0]
        some, counts = _counted(some, counts[counts > 0])
        levels = level_of(counts)
        held = CountFilter.empty(max(64, int(levels.sum(dtype=np.int64)) * BITS_PER_ENTRY // 8 + 1), 1)
        held.add(some, levels)
        cids, found = [None], [held.flat.tobytes()]
        for cid, own in zip(group["cid"].to_pylist(), keys, strict=True):
            if cid is not None:
                levels = held.levels(own)
                cids.append(cid)
                found.append(len(levels).to_bytes(8, "little") + pa.compress(levels.tobytes(), "zstd", asbytes=True))
        return pa.table({"cid": pa.array(cids, pa.int64()), "slice": pa.array([group["slice"][0].as_py()] * len(cids), pa.int32()), "levels": pa.array(found, pa.binary())})

    return asked.groupBy("slice").applyInArrow(answer, "cid long, slice int, levels binary")


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, head_known long, head_sum double, score double, rare array<long>"


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = FILTER_BYTES, head: int = HEAD, lam: float = LAM) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    ship(spark)
    plain = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    train = plain.where(F.coalesce(F.crc32(F.col("id").cast("string")) % 7, F.lit(0)) != 2)
    counts = store(word_counts(train), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # The head: words of a count that few enough reach.
    sizes = sorted(((r["p"], r["count"]) for r in counts.groupBy(F.floor(F.log2("c") * 4).alias("p")).count().collect()), reverse=True)
    taken, reach = 0, None
    for power, n in sizes:
        if taken + n > head:
            break
        taken, reach = taken + n, power
    top = counts.where(F.floor(F.log2("c") * 4) >= reach).collect() if reach is not None else []
    top_h = np.array([r.h for r in top], np.int64).view(np.uint64)
    order = np.argsort(top_h)
    shared = spark.sparkContext.broadcast(Head(top_h[order], np.array([r.c for r in top], np.int64)[order]))
    # Slices of bounded size, by what may go into one (train) and be asked of one (all text).
    size = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    most = min(PAIRS_PER_BUCKET, max(1, filter_bytes * 8 // BITS_PER_ENTRY))
    tokens = max(1, total, size // BYTES_PER_TOKEN)
    slices = max(-(-tokens // most), min(SLICES, -(-tokens // LEAST_PER_SLICE)))
    chunks = store(text_chunks(plain), "chunks")
    answers = probed_levels(asked_keys(chunks, counts, slices, shared)).where("cid is not null")
    ground = total + distinct + 1

    def work(chunk: pa.Table, found: pa.Table) -> pa.Table:
        rid = chunk["cid"][0].as_py()
        c = _Chunk.read(chunk["docs"][0].as_py(), shared.value)
        parts = [found["levels"][int(i)].as_py() for i in np.argsort(found["slice"].to_numpy())]
        levels = [np.frombuffer(pa.decompress(p[8:], int.from_bytes(p[:8], "little"), "zstd", asbytes=True), np.uint8) for p in parts]
        each, joint = c.counts(np.concatenate(levels))
        single = each[c.back]
        first = np.concatenate([each[np.searchsorted(c.own, END)][None], single[:-1]])
        plain_p = (single + 1) / ground
        mixed = np.where(first > 0, lam * np.minimum(1.0, joint / np.maximum(first, 1.0)) + (1 - lam) * plain_p, plain_p)
        per_row = lambda x: np.add.reduceat(x, c.starts[:-1])
        rare = ~c.in_head[c.back]
        ends = np.concatenate([[0], np.cumsum(per_row(rare.astype(np.int64)))])
        names = c.ids.to_pylist()
        return pa.Table.from_arrays(
            [
                pa.array(rid + np.arange(len(names))), c.ids, pa.array([is_held_out(i) for i in names]),
                pa.array(np.diff(c.starts)), pa.array(per_row((c.exact > 0)[c.back].astype(np.int64))), pa.array(per_row(np.log10(c.exact + 1.0)[c.back])),
                pa.array(per_row(np.log10(mixed))), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c.tokens[rare].view(np.int64))),
            ],
            names=[f.split()[0] for f in SCORED.split(", ")],
        )

    scored = store(chunks.groupBy("cid").cogroup(answers.groupBy("cid")).applyInArrow(work, SCORED), "scored")
    rare = scored.select("rid", F.explode("rare").alias("h")).join(counts, "h").groupBy("rid").agg(F.count("*").alias("known"), F.sum(F.log10(F.col("c") + 1)).alias("logs"))
    both = scored.drop("rare").join(rare, "rid", "left")
    base = F.col("head_sum") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(ground)))
    return both.select("doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_lm_score": op9_lm_score}
ORACLES: dict[str, str] = {}
