"""Operator 4: benchmark decontamination by suffix arrays over the training text.

Each few megabytes of documents are a shard. Words that no benchmark item contains split its text; the suffixes between those
splits that are long enough to match are sorted by their first `window` words, and every test suffix is found in that
order by binary search. A suffix of the test text is sought by its first `window` words, which is all that a hit depends on;
neighbouring hits on a diagonal join into the longest verbatim matches, with their places. Nothing is shuffled.

The benchmark is indexed in blocks of bounded size (by its bytes, measured first), each built by a task; with several blocks each
shard is searched by one block after the other, so neither driver nor worker holds more than a block: the driver ships one and forgets it
before it takes the next.

A window that many items share is one entry of the index with a list of its items. Hits are kept as (position, entry), and items are looked up once for
each different set of entries that a document has and each different run of neighbouring ones, so documents times items are never listed.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. An item of fewer words than a window is one
window; items and documents of null or empty text have no words and match nothing; a very long document is a shard of its own.
Equal items each count; all items with a null name are one item, which counts in n_hit, n_items and contaminated but has no name in the
digest. Every row, a repeated one too, gives a row; an empty table gives an empty result, and an empty benchmark leaves all clean.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import discard, giving_back, row_blocks, ship, store, text_buffers

WINDOW = 10
#: Benchmark text in one index; an index takes about 37 bytes for each of its bytes while it is built, and 9 after that.
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 3 << 20
SCHEMA = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "longest long, longest_item string, longest_item_start long, longest_start long"
)
_WORD = np.ones(256, bool)
_WORD[0x00:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False
_MAP = bytes(b + 32 if 65 <= b <= 90 else b if _WORD[b] else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_MAP).split() if text else []


class TestIndex:
    """Every window of a block of items, as a key of big-endian word numbers, with where it occurs."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        """items: in the order of their names, those without one last."""
        self.vocab: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        self.rank = np.cumsum([i > 0 and n != self.names[i - 1] for i, n in enumerate(self.names)], dtype=np.int64)
        sizes = np.array([len(w) for _, w in items], np.int64)
        ids = np.fromiter((self.vocab.setdefault(w, len(self.vocab) + 1) for _, words in items for w in words), ">u4", int(sizes.sum()))
        begins = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
        self.window = window
        # Of each length, distinct keys: least and greatest suffix that begins with one. Entry e has the places `places[first[e] : first[e + 1]]`.
        self.lengths: list[tuple[int, np.ndarray, np.ndarray]] = []
        firsts, places, done = [], [], 0
        for length in np.unique(np.minimum(sizes, window)).tolist():
            if not length:
                continue
            own = np.flatnonzero(np.minimum(sizes, window) == length)
            counts = sizes[own] - length + 1
            item = np.repeat(own, counts)
            start = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            at = begins[item] + start
            entries = np.empty((len(at), length), ">u4")
            for k in range(length):
                entries[:, k] = ids[at + k]
            keys = entries.view(f"S{4 * length}").ravel()
            order = np.argsort(keys, kind="stable")
            keys, first = np.unique(keys[order], return_index=True)
            low = keys.astype(f"S{4 * window}")
            tail = b"\xff" * (4 * (window - length))
            high = np.array([t.ljust(4 * length, b"\0") + tail for t in keys.tolist()], low.dtype) if tail else low
            self.lengths.append((length, low, high))
            firsts.append(first + done)
            places.append(item[order] << 32 | start[order])
            done += len(order)
        self.first = np.append(np.concatenate(firsts), done) if firsts else np.zeros(1, np.int64)
        self.places = np.concatenate(places) if places else np.zeros(0, np.int64)

    @property
    def shortest(self) -> int:
        return self.lengths[0][0] if self.lengths else 0

    def places_of(self, entry: int) -> np.ndarray:
        """item << 32 | start of each place of an entry, ascending."""
        return self.places[self.first[entry] : self.first[entry + 1]]

    def longest(self, run: tuple[int, ...]) -> tuple[int, int, int, int]:
        """(-words, which of the run, rank of the item's name, start in the item) of the longest match among entries at neighbouring positions."""
        best, before, heads = (0, 0, 0, 0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for j, entry in enumerate(run):
            own = self.places_of(entry)
            at = np.minimum(np.searchsorted(before, own - 1), max(len(before) - 1, 0))
            heads = np.where(before[at] == own - 1, heads[at], j) if len(before) else np.full(len(own), j)
            head = int(heads.min())
            if self.window + j - head > -best[0]:
                some = own[heads == head]
                rank, start = self.rank[some >> 32], (some & 0xFFFFFFFF) - (j - head)
                least = rank.min()
                best = (head - j - self.window, head, int(least), int(start[rank == least].min()))
            before = own
        return best


def suffix_array(ids: np.ndarray, shortest: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, keys): suffixes that begin with at least `shortest` known words (id > 0), sorted by their first `window` ids."""
    unknown = np.flatnonzero(ids == 0)
    stops = np.append(unknown, len(ids))
    room = stops[np.searchsorted(stops, np.arange(len(ids)), "left")] - np.arange(len(ids))
    at = np.flatnonzero(room >= shortest)
    wide = np.concatenate([ids, np.zeros(window, ids.dtype)])
    step = np.arange(window)
    keys = np.where(step < room[at, None], wide[at[:, None] + step], 0).astype(">u4") if len(at) else np.zeros((0, window), ">u4")
    keys = np.ascontiguousarray(keys).view(f"S{4 * window}").ravel()
    order = np.argsort(keys, kind="stable")
    return at[order], keys[order]


def search(index: TestIndex, positions: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text position, entry, its length) of every occurrence of a window, by position."""
    at, entries, lengths, done = [], [], [], 0
    for length, least, greatest in index.lengths:
        low = np.searchsorted(keys, least.astype(keys.dtype), "left")
        many = np.searchsorted(keys, greatest.astype(keys.dtype), "right") - low
        hit = np.flatnonzero(many > 0)
        many, low = many[hit], low[hit]
        place = np.arange(int(many.sum())) + np.repeat(low - (np.cumsum(many) - many), many)
        at.append(positions[place])
        entries.append(np.repeat(hit + done, many))
        lengths.append(np.full(len(place), length))
        done += len(least)
    at, entries, lengths = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, entries, lengths))
    order = np.argsort(at, kind="stable")
    return at[order], entries[order], lengths[order]


def build_indexes(benchmark: DataFrame, item_col: str, item_text_col: str, window: int, block_bytes: int) -> list:
    """Broadcast indexes (pickled) of all items, each over items of about block_bytes of text."""
    spark = benchmark.sparkSession
    ship(spark)
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[item_text_col].cast("string").alias("words"))
    total = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    block = F.pmod(F.xxhash64("item", "words"), F.lit(total // block_bytes + 1)).cast("int").alias("block")

    def index(group: pa.Table) -> pa.Table:
        rows = zip(group["item"].to_pylist(), group["words"].to_pylist(), strict=True)
        rows = sorted(((name, words_of(text)) for name, text in rows), key=lambda x: (x[0] is None, x[0] or "", x[1]))
        return pa.table({"block": group["block"].slice(0, 1), "data": pa.array([pickle.dumps(TestIndex(rows, window))], pa.binary())})

    built = store(items.select(block, "item", "words").groupBy("block").applyInArrow(index, "block int, data binary"), "indexes")
    indexes = [spark.sparkContext.broadcast(bytes(r.data)) for r in built.select("data").toLocalIterator()]
    discard(built)
    return indexes


_lone: dict[int, TestIndex] = {}


def _each(indexes: list) -> Iterator[TestIndex]:
    """One block's index after the other; a worker keeps only a lone one."""
    if len(indexes) == 1:
        data = indexes[0].value
        if id(data) not in _lone:
            _lone.clear()
            _lone[id(data)] = pickle.loads(data)
        yield _lone[id(data)]
    else:
        for shared in indexes:
            yield pickle.loads(shared.load_from_path(shared._path))


def _shards(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Parts of batches of bounded text size, with the words of each document."""
    for batch in batches:
        column = batch.column(text_at)
        column = column if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(pa.string())
        for first, last in row_blocks(text_buffers(column)[1], SHARD_BYTES):
            yield batch.slice(first, last - first), [words_of(t.as_py()) for t in column.slice(first, last - first)]


def _starts(words: list[list[bytes]]) -> np.ndarray:
    """First word of each document in a shard; one unknown word stands after each, so that no match spans two."""
    return np.concatenate([[0], np.cumsum(np.array([len(w) + 1 for w in words], np.int64))]).astype(np.int64)


def _hits(index: TestIndex, words: list[list[bytes]], first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, get = np.zeros(first[-1], np.int64), index.vocab.get
    for at, own in zip(first.tolist(), words, strict=False):
        ids[at : at + len(own)] = np.fromiter(map(get, own, repeat(0)), np.int64, len(own))
    return search(index, *suffix_array(ids, max(index.shortest, 1), window))


def shard_columns(words: list[list[bytes]], indexes: Iterable[TestIndex], window: int) -> list[list]:
    """What SCHEMA has after the id, of the documents of a shard."""
    first = _starts(words)
    change = np.zeros(first[-1] + 1, np.int64)
    sets: list[list[tuple]] = [[] for _ in words]  # of each document, names by set of entries
    best: list[tuple] = [(0, 0, False, "", 0)] * len(words)
    for index in indexes:
        at, entry, length = _hits(index, words, first, window)
        np.add.at(change, at, 1)
        np.add.at(change, at + length, -1)
        known: dict[bytes, tuple] = {}
        names_of: dict[int, tuple] = {}
        matches: dict[tuple, tuple] = {}
        doc = np.searchsorted(first, at, "right") - 1
        edges = np.flatnonzero(np.diff(doc, prepend=-1, append=-1)).tolist()
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            d, mine = int(doc[i]), {}
            for e in np.unique(entry[i:j]).tolist():
                if e not in names_of:
                    ranks, one = np.unique(index.rank[index.places_of(e) >> 32], return_index=True)
                    key = ranks.tobytes()
                    if key not in known:
                        known[key] = tuple(index.names[k] for k in (index.places_of(e)[one] >> 32).tolist())
                    names_of[e] = known[key]
                mine[id(names_of[e])] = names_of[e]
            sets[d].extend(mine.values())
            whole = np.flatnonzero(length[i:j] == window) + i
            if len(whole):
                runs = [(int(p[0]), tuple(entry[p].tolist())) for p in np.split(whole, np.flatnonzero(np.diff(at[whole]) != 1) + 1)]
            else:  # only items of fewer words, which match whole
                runs = [(p, (int(entry[p]),)) for p in range(i, j)]
            for p, run in runs:
                if run not in matches:
                    matches[run] = index.longest(run)
                n, k, rank, start = matches[run]
                n = n if len(whole) else -int(length[p])
                name = index.names[int(np.searchsorted(index.rank, rank))]
                best[d] = min(best[d], (n, int(at[p]) + k - int(first[d]), name is None, name or "", start))
    covered = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    n_hit = (covered[first[1:] - 1] - covered[first[:-1]]).tolist()
    told: dict[tuple, tuple[int, str]] = {}
    counts, digests = [], []
    for own in sets:
        key = tuple(sorted(map(id, own)))
        if key not in told:
            names = set().union(*own)
            told[key] = len(names), hashlib.sha256(",".join(sorted(n for n in names if n is not None)).encode()).hexdigest()
        counts.append(told[key][0])
        digests.append(told[key][1])
    return [
        [len(w) for w in words], n_hit, counts, digests, [n > 0 for n in n_hit], [-b[0] for b in best],
        [b[3] if b[0] and not b[2] else None for b in best], [b[4] if b[0] else None for b in best], [b[1] if b[0] else None for b in best],
    ]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of any item."""
    indexes, at = build_indexes(benchmark, item_col, item_text_col, window, block_bytes), docs.columns.index(text_col)
    names = [f"__c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in _shards(batches, at):
            first, clean = _starts(words), np.ones(len(words), bool)
            for index in _each(indexes):
                clean[np.searchsorted(first, _hits(index, words, first, window)[0], "right") - 1] = False
            yield batch.filter(pa.array(clean))

    plain = docs.toDF(*names)
    return plain.mapInArrow(giving_back(run), plain.schema).toDF(*docs.columns)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document (SCHEMA). longest: words of its longest verbatim match of a window or more, 0 if none;
    on a tie the first in the document, then of the first item as a string, one without a name last."""
    indexes = build_indexes(benchmark, item_col, item_text_col, window, block_bytes)

    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in _shards(batches, 1):
            columns = shard_columns(words, _each(indexes), window)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(giving_back(run), SCHEMA)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "longest_item", "longest_item_start", "longest_start")


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLES = {
    "op4_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
u AS (SELECT item_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS k
      FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
t AS (SELECT DISTINCT item_id, n, k FROM u),
p AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS k
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM t) WHERE len(w) >= n)),
h AS (SELECT p.doc_id, p.s, p.n, t.item_id FROM p JOIN t ON p.n = t.n AND p.k = t.k),
c AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id),
q AS (SELECT p.doc_id, CAST(u.item_id AS VARCHAR) AS item, p.n, p.s AS pos, u.s AS start, p.s - u.s AS diagonal FROM p JOIN u ON p.n = u.n AND p.k = u.k),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, item, diagonal ORDER BY pos) AS run FROM q),
l AS (SELECT doc_id, item, count(*) - 1 + min(n) AS longest, min(pos) - 1 AS pos, min(start) - 1 AS start FROM g GROUP BY doc_id, item, diagonal, run),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY longest DESC, pos, item, start) AS r FROM l)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated,
       coalesce(o.longest, 0) AS longest, o.item AS longest_item, CAST(o.start AS BIGINT) AS longest_item_start, CAST(o.pos AS BIGINT) AS longest_start
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN o ON o.doc_id = d.doc_id AND o.r = 1"""
}
