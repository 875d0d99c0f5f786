"""Operator 12: maximal periodic runs of words, by a suffix tree over each document's words.

The tree is that of Stoye and Gusfield's search for tandem repeats. Suffixes are ordered by prefix doubling, neighbours'
common prefixes give the tree's inner nodes, each as a split of an interval of suffixes in two. Of each node of depth D the
leaves of the smaller half are listed, and for each leaf x it is seen whether x + D or x - D lies in the other half: if so,
the two places are a tandem repeat of period D that the next word ends (a branching one). Each leaf is listed at most log2(n)
times. Every run ends with exactly one branching repeat of its period; rotating that to the left, as long as words D apart
are equal, gives where the run starts. Repeats whose period is a multiple of a smaller one merge into the same run.

A run of `least` words and `times` periods holds two equal stretches of least - least // times words. A document in which no
stretch of that many words occurs twice (by hash; equal hashes of unequal stretches only keep a document) has no run and needs no tree.

Documents are told apart in the tree by their number, so that those of a block share one suffix order and no repeat goes
from one to the next. A text longer than a block is a block of its own; its tree takes about 4 * log2(n) + 60 bytes a word.

Null and empty text, and text of blanks alone, have no words: no runs, nulls for the run, digests of the empty string. Rows of a
null id are not rewritten by `rewritten`. Every row gives a row, repeated ones included; ties are as stated. An empty table gives an empty
result. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from binascii import crc32
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._shared import mix, row_blocks, ship, text_buffers

LEAST, TIMES = 24, 3
#: Leaves listed at once; bounds the memory of the traversal.
LISTED = 1 << 20
_STEPS = 32


def _with_repeats(words: np.ndarray, owner: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Which documents hold a stretch of `width` words twice, some others perhaps too."""
    n = len(words)
    if n <= width:
        return np.zeros(0, np.int64)
    step = np.uint64(0x9E3779B97F4A7C15)
    h = mix((words + 1).astype(np.uint64) * step ^ mix((owner + 1).astype(np.uint64) * step))
    size = 1
    while 2 * size <= width:
        h = mix(h[:-size] * step + h[size:])
        size *= 2
    rest = width - size
    if rest:
        h = mix(h[:-rest] * step + h[rest:])
    whole = np.flatnonzero(np.arange(len(h)) + width <= ends[owner[: len(h)]])
    order = whole[np.argsort(h[whole])]
    return np.unique(owner[order[1:][h[order[1:]] == h[order[:-1]]]])


def _suffixes(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of all suffixes, each one's place in it, common prefix of each with the next) of symbols from 1, which tell documents apart."""
    n = len(first)
    ranks, size = [np.append(first, 0).astype(np.int32)], 1
    while True:
        rank = ranks[-1]
        key = rank[:-1].astype(np.int64) * (n + 1)
        key[: max(0, n - size)] += rank[size:-1]
        order = np.argsort(key, kind="stable")
        new = np.zeros(n + 1, np.int32)
        new[order] = np.cumsum(np.diff(key[order], prepend=-1) != 0)
        ranks.append(new)
        size *= 2
        if new.max() == n:
            break
    common = np.zeros(n - 1, np.int64)
    a, b = order[:-1], order[1:]
    for k in range(len(ranks) - 2, -1, -1):
        common += (ranks[k][a + common] == ranks[k][b + common]).astype(np.int64) << k
    return order, ranks[-1][:-1] - 1, common


def _nodes(common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place between neighbours, seen as a split of suffixes: first and last suffix of the interval it splits."""
    depth, open_, n = common.tolist(), [], len(common)
    left, right = [0] * n, [n] * n
    for at, d in enumerate(depth):
        while open_ and depth[open_[-1]] > d:
            right[open_.pop()] = at
        if open_:
            left[at] = open_[-1] + 1
        open_.append(at)
    return np.array(left, np.int64), np.array(right, np.int64)


def branching_repeats(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every tandem repeat that does not go on to the right, each once."""
    n = len(symbols)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, place, common = _suffixes(symbols)
    left, right = _nodes(common)
    at = np.flatnonzero(common)
    left, right, depth = left[at], right[at], common[at]
    lower = at - left + 1 <= right - at
    first = np.where(lower, left, at + 1)
    many = np.where(lower, at - left + 1, right - at)
    other, last = np.where(lower, at + 1, left), np.where(lower, right, at)
    starts, periods = [], []
    upto = np.cumsum(many)
    done = 0
    while done < len(at):
        stop = max(done + 1, int(np.searchsorted(upto, upto[done] - many[done] + LISTED, "right")))
        own = many[done:stop]
        node = np.repeat(np.arange(done, stop), own)
        leaf = order[first[node] + np.arange(len(node)) - np.repeat(np.cumsum(own) - own, own)]
        d = depth[node]
        for begin, end in ((leaf, leaf + d), (leaf - d, leaf)):
            far = end if begin is leaf else begin
            inside = np.flatnonzero((far >= 0) & (far < n))
            rank, k = place[far[inside]], node[inside]
            hit = inside[(rank >= other[k]) & (rank <= last[k])]
            starts.append(begin[hit])
            periods.append(d[hit])
        done = stop
    return np.concatenate(starts) if starts else np.zeros(0, np.int64), np.concatenate(periods) if periods else np.zeros(0, np.int64)


def _rotated(symbols: np.ndarray, start: int, period: int) -> int:
    """Where the run starts that the repeat at start belongs to."""
    width = 4 * _STEPS
    while start:
        low = max(0, start - width)
        unequal = np.flatnonzero(symbols[low:start] != symbols[low + period : start + period])
        if len(unequal):
            return low + int(unequal[-1]) + 1
        start, width = low, 2 * width
    return 0


def maximal_runs(words: np.ndarray, offsets: np.ndarray, least: int = LEAST, times: int = TIMES) -> dict[int, list[tuple[int, int, int]]]:
    """Per document that has any: its runs (start, length, smallest period) of at least `least` words and `times` periods, by start, then period.

    words: numbers of the words of all documents, one after another; offsets: where each document begins, and the end.
    """
    counts = np.diff(offsets)
    owner = np.repeat(np.arange(len(counts)), counts)
    some = _with_repeats(words, owner, offsets[1:], least - least // times)
    if not len(some):
        return {}
    kept = np.isin(owner, some)
    owner, words = owner[kept], words[kept]
    symbols = np.unique(owner * (int(words.max()) + 1) + words, return_inverse=True)[1] + 1
    begins = np.zeros(len(counts), np.int64)
    begins[some] = np.cumsum(counts[some]) - counts[some]

    start, period = branching_repeats(symbols)
    # Symbols tell documents apart, so a rotation ends at its document's start by itself, but for the first document's.
    short = np.maximum(least - 2 * period, (times - 2) * period)
    for step in range(1, _STEPS + 1):
        back = np.maximum(start - step, 0)
        alive = (short < step) | ((start >= step) & (symbols[back] == symbols[back + period]))
        start, period, short = start[alive], period[alive], short[alive]

    found: dict[int, list[tuple[int, int, int]]] = {}
    end = start + 2 * period
    before, here = -1, []
    for k in np.lexsort((period, end)).tolist():
        e, p = int(end[k]), int(period[k])
        if e != before:
            before, here = e, []
        if any(p % q == 0 and e - 2 * p >= s for s, q in here):
            continue
        s = _rotated(symbols, int(start[k]), p)
        here.append((s, p))
        if e - s >= max(least, times * p):
            doc = int(owner[s])
            found.setdefault(doc, []).append((s - int(begins[doc]), e - s, p))
    return {doc: sorted(runs, key=lambda r: (r[0], r[2])) for doc, runs in found.items()}


def rewritten(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's words: one document of ten repeats a stretch of its own words from some word on. A fixed rule, by the id."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES, rewrite: Callable | None = None, collapsed: bool = False) -> DataFrame:
    """Per row: doc_id, runs (array of start, length, period in words, by start, then period), collapsed_sha256, and the collapsed text if asked for.

    The collapsed text has of every run its first period, words joined by one space. rewrite(id, words) may give other words to look at.
    """
    ship(docs.sparkSession)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    schema = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed_sha256 string" + ", collapsed string" * collapsed

    def block(ids: list, raw: np.ndarray, offsets: np.ndarray) -> tuple[list, list, list]:
        whole, numbers, texts, counts, flat = raw.tobytes(), {}, [], [], []
        for i, doc in enumerate(ids):
            words = whole[offsets[i] : offsets[i + 1]].split()
            words = rewrite(doc, words) if rewrite else words
            texts.append(words)
            counts.append(len(words))
            flat.extend([numbers.setdefault(w, len(numbers)) for w in words])
        found = maximal_runs(np.array(flat, np.int64), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), least, times)
        out = []
        for i, words in enumerate(texts):
            if i in found:
                gone = np.zeros(len(words) + 1, np.int64)
                for s, length, p in found[i]:
                    gone[s + p] += 1
                    gone[s + length] -= 1
                words = [words[j] for j in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
            out.append(b" ".join(words))
        return [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found.get(i, ())] for i in range(len(ids))], [_digest(t) for t in out], out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for first, last in row_blocks(offsets):
                ids = batch.column(0).slice(first, last - first)
                at = offsets[first : last + 1]
                runs, digests, texts = block(ids.to_pylist(), raw[at[0] : at[-1]], at - at[0])
                columns = [ids, pa.array(runs, run_type), pa.array(digests)] + [pa.array([t.decode() for t in texts], pa.string())] * collapsed
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "runs", "collapsed_sha256", "collapsed"][: len(columns)])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)


def summary(found: DataFrame) -> DataFrame:
    """Of find_runs: n_runs, the run of greatest exponent (ties: smallest start, then period) and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for runs in batch.column(1).to_pylist():
                listed = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs)
                best = min(runs, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"]), default=None)
                own = (best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"]) if best else (None,) * 4
                rows.append((len(runs), *own, _digest(listed.encode())))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, batch.column(2)], names=names)

    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    schema = ", ".join(f"{n} {'string' if n.endswith('sha256') else 'long'}" for n in names)
    return found.mapInArrow(run, schema)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(find_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), rewrite=rewritten))


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLES: dict[str, str] = {}
