"""Operator 6: near duplicates by an inverted join over MinHash signature coordinates.

1. Each text becomes the set of its 5-word shingles (as 64-bit hashes), a signature of 32 coordinates, and a 128-bit digest
   of the set; texts of equal sets form a class, and its smallest id goes on alone.
2. A signature's coordinates, tagged with their place, are its tokens. Tokens that only one class has are dropped, and
   with them every class that keeps fewer than `matches` tokens, since it can match nothing.
3. Each class is posted under its rarest tokens: of t tokens the first t - matches + 1 (the prefix); two classes that share
   `matches` tokens meet there. In each posting list one class is the pivot, the one whose tokens are the
   most frequent; all others are paired with it. Pairs that collide in enough coordinates are confirmed on full sets.
4. Confirmed pairs give components. Lists whose members fall into one component are skipped. In each list that still holds
   several, the classes outside its main component are merged with all its classes, in blocks of bounded size: collisions
   are counted over the inverted lists of the rarer coordinates (the prefix), the longest lists are skipped and only probed for
   pairs that can still reach `matches`, and pairs of one component are left out. What comes back is which
   classes collide enough with which other component, not the pairs.
5. Only those classes go on with their full sets, in clusters of components that collide, and are compared by counting common
   shingles; pairs connected meanwhile are skipped. Only links that join components come back.

`matches` follows from `percent`: the most at which a pair at that similarity is missed with probability below 1e-7, a closer one
less (15 of 32 coordinates at 0.85, 12 at 0.8). Nothing is capped. Work on a group of n near copies is n for those linked to the pivot. A list of
n classes with r outside its main component sends n rows for each `block_rows` of the r, and r rows for each `block_rows` of the n; up to `block_rows`
others it is sent once. A group with many others that all collide with it but link with nothing costs r x n counts, the least that an exact answer can ask.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a text of fewer than five words is one shingle. Null, empty and
blank texts have no shingles, link with nothing and are kept. Very long texts are whole sets like any other. Rows of equal id,
of equal or other texts, are one document and share its component; rows with a null id link with nothing (component null, kept). An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import discard, giving_back, hashed_words, mix, row_blocks, ship, store, text_buffers
from .components import connected_components

WORDS = 5
PERCENT = 85
COORDINATES = 32
#: Most probability that a pair at the threshold itself is missed.
MISS = 1e-7
BLOCK_ROWS = 512
BLOCK_BYTES = 32 << 20
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(77003)
_PLACE = _rng.integers(1, 1 << 62, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 1 << 63, 64, dtype=np.uint64)
_TIMES = _rng.integers(1 << 60, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def matches_for(percent: int, coordinates: int = COORDINATES) -> int:
    """The most matches to ask for: a pair of similarity percent / 100 has fewer with probability below MISS."""
    p, missed, matches = percent / 100, 0.0, 0
    while matches < coordinates:
        missed += math.comb(coordinates, matches) * p**matches * (1 - p) ** (coordinates - matches)
        if missed >= MISS:
            break
        matches += 1
    if not matches:
        raise ValueError(f"{coordinates} coordinates are too few for {percent} percent")
    return matches


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one row after the other, and the first of each row."""
    words, firsts = hashed_words(raw, offsets)
    counts = np.diff(firsts)
    n = len(words)
    room = np.maximum(n - WORDS + 1, 0)
    sums = np.zeros(room, np.uint64)
    for k in range(WORDS):
        sums += words[k : k + room] * _PLACE[k]
    sums = mix(sums)
    parts, sizes = [], np.zeros(len(counts), np.int64)
    for i, (first, count) in enumerate(zip(firsts[:-1].tolist(), counts.tolist(), strict=True)):
        if count >= WORDS:
            own = np.sort(sums[first : first + count - WORDS + 1])
            if len(own) > 1:
                keep = np.empty(len(own), bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                own = own[keep]
        elif count:
            own = mix(np.array([np.sum(words[first : first + count] * _PLACE[:count]) + np.uint64(count)], np.uint64))
        else:
            continue
        parts.append(own)
        sizes[i] = len(own)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, shingles, firsts) of parts of bounded text size of batches (id, text)."""
    for batch in batches:
        raw, offsets = text_buffers(batch.column(1))
        for first, last in row_blocks(offsets):
            at = offsets[first : last + 1]
            yield batch.column(0).slice(first, last - first), *shingle_sets(raw[at[0] : at[-1]], at - at[0])


SIGNED = "id long, n long, d1 long, d2 long, tokens array<long>"


def signatures(docs: DataFrame, coordinates: int = COORDINATES) -> DataFrame:
    """Of docs (id, text): size and digest of the shingle set, and its tokens (coordinate values tagged with their place)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, shingles, firsts in _blocks(batches):
            sizes = np.diff(firsts)
            full = np.flatnonzero(sizes)
            digests = np.zeros((2, len(sizes)), np.uint64)
            tokens = np.zeros((len(full), coordinates), np.uint64)
            if len(full):
                starts = firsts[full]
                for j, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
                    digests[j, full] = np.add.reduceat(mix(shingles ^ np.uint64(salt)), starts)
                for k in range(coordinates):
                    low = np.minimum.reduceat((shingles ^ _FLIP[k]) * _TIMES[k], starts)
                    tokens[:, k] = low >> np.uint64(6) << np.uint64(6) | np.uint64(k)
            ends = np.concatenate([[0], np.cumsum((sizes > 0) * coordinates)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), *(pa.array(d.view(np.int64)) for d in digests), lists], names=["id", "n", "d1", "d2", "tokens"])

    return docs.mapInArrow(giving_back(work), SIGNED)


def sets_of(docs: DataFrame) -> DataFrame:
    """Of docs (id, text): (node, shingles), the full sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, shingles, firsts in _blocks(batches):
            lists = pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pa.array(shingles.view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, lists], names=["node", "shingles"])

    return docs.mapInArrow(giving_back(work), "node long, shingles array<long>")


def _linked(common, left, right, percent: int):
    return 100 * common >= percent * (left + right - common)


class _Union:
    """Components joined so far, each known by its least."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.get(x, x) != x:
            x = parent[x] = parent.get(parent[x], parent[x])
        return x

    def join(self, x: int, y: int) -> bool:
        """True if the two were apart."""
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _collide(matches: int):
    """Which rows of one pair of blocks of a posting list share `matches` tokens with a row of another component; beside each the
    least of the components that such rows tie to its own."""

    def work(group: pa.Table) -> pa.Table:
        nodes, comps = group["node"].to_numpy(), group["comp"].to_numpy()
        side = group["residual_side"].to_numpy(zero_copy_only=False)
        column = group["tokens"].combine_chunks()
        values, at = column.values.to_numpy(), column.offsets.to_numpy()
        sizes = np.diff(at)
        own, across = np.flatnonzero(side), np.flatnonzero(~side)
        held_comps = comps[across]
        # Inverted lists of this block: for each token the rows that hold it, ascending.
        flat, holder = np.concatenate([values[at[j] : at[j + 1]] for j in across]), np.repeat(np.arange(len(across)), sizes[across])
        order = np.argsort(flat, kind="stable")
        held, rows_of = flat[order], holder[order]
        found: set[int] = set()
        ties = _Union()
        for i in own.tolist():
            mine = values[at[i] : at[i + 1]]
            low, high = np.searchsorted(held, mine, "left"), np.searchsorted(held, mine, "right")
            # Merge all lists but the matches - 1 longest; who is on none of them can't reach `matches`.
            by_length = np.argsort(high - low, kind="stable").tolist()
            merged, skipped = by_length[: len(mine) - matches + 1], by_length[len(mine) - matches + 1 :]
            count = np.bincount(np.concatenate([rows_of[low[k] : high[k]] for k in merged]), minlength=len(across))
            alive = np.flatnonzero((count > 0) & (held_comps != comps[i]))
            for left, k in zip(range(len(skipped), 0, -1), skipped, strict=True):
                alive = alive[count[alive] + left >= matches]
                if not len(alive):
                    break
                longer = rows_of[low[k] : high[k]]
                place = np.searchsorted(longer, alive)
                count[alive] += (place < len(longer)) & (longer[np.minimum(place, len(longer) - 1)] == alive) if len(longer) else 0
            near = across[alive[count[alive] >= matches]]
            if len(near):
                found.add(i)
                found.update(near.tolist())
                for c in np.unique(comps[near]).tolist():
                    ties.join(int(comps[i]), c)
        rows = np.array(sorted(found), np.int64)
        tied = [ties.root(c) for c in comps[rows].tolist()]
        return pa.table({"node": pa.array(nodes[rows]), "comp": pa.array(comps[rows]), "other": pa.array(tied, pa.int64())})

    return work


def _compare(percent: int):
    """Links between residual and all classes of one pair of blocks, but those inside a component found so far."""

    def work(group: pa.Table) -> pa.Table:
        nodes, comps = group["node"].to_numpy(), group["comp"].to_numpy()
        side, loose = group["residual_side"].to_numpy(zero_copy_only=False), group["residual"].to_numpy(zero_copy_only=False)
        column = group["shingles"].combine_chunks()
        values, at = column.values.to_numpy(), column.offsets.to_numpy()
        own, across = np.flatnonzero(side), np.flatnonzero(~side)
        # Inverted lists over the `across` side: for each shingle the rows that hold it.
        sizes = np.diff(at)
        holder = np.repeat(np.arange(len(across)), sizes[across])
        held = np.concatenate([values[at[i] : at[i + 1]] for i in across]) if len(across) else np.zeros(0, np.int64)
        order = np.argsort(held, kind="stable")
        held, holder = held[order], holder[order]
        known = _Union()
        found: list[tuple[int, int]] = []
        for i in own.tolist():
            mine = values[at[i] : at[i + 1]]
            low, high = np.searchsorted(held, mine, "left"), np.searchsorted(held, mine, "right")
            runs = high - low
            total = int(runs.sum())
            if not total:
                continue
            rows = np.arange(total) + np.repeat(low - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs)
            common = np.bincount(holder[rows], minlength=len(across))
            near = np.flatnonzero(_linked(common, len(mine), sizes[across], percent))
            for j in across[near].tolist():
                if nodes[j] == nodes[i] or loose[j] and nodes[j] < nodes[i]:
                    continue
                if known.join(int(comps[i]), int(comps[j])):
                    found.append((int(nodes[i]), int(nodes[j])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return work


def classes_of(docs: DataFrame, coordinates: int = COORDINATES, matches: int | None = None, percent: int = PERCENT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Of docs (id, text): one row per row, (id, n_shingles, component_id, kept)."""
    ship(docs.sparkSession)
    matches = matches or matches_for(percent, coordinates)
    signed = store(signatures(docs, coordinates), "signatures")
    nodes = signed.where("n > 0 and id is not null")
    classes = store(nodes.groupBy("d1", "d2", "n").agg(F.min("id").alias("node")), "classes")
    firsts = nodes.join(classes.withColumnRenamed("node", "id"), ["id", "d1", "d2", "n"], "left_semi").select(F.col("id").alias("node"), "tokens").distinct()
    posted = firsts.select("node", F.explode("tokens").alias("token"))
    shared = posted.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    by_node = posted.join(shared, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    live = store(by_node.where(F.size("tokens") >= matches), "live")
    repeated = not signed.groupBy("id").count().where("count > 1").isEmpty()
    edges = _edges(docs, live, matches, percent, block_rows, repeated)
    final = connected_components(edges) if edges is not None else None
    out = signed.join(classes, ["d1", "d2", "n"], "left")
    if final is not None:
        out = out.join(final, "node", "left")
        component = F.coalesce("component", "node", "id")
    else:
        component = F.coalesce("node", "id")
    component = F.when(F.col("id").isNotNull(), component)
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _edges(docs: DataFrame, live: DataFrame, matches: int, percent: int, block_rows: int, repeated: bool) -> DataFrame | None:
    """Confirmed links (a, b) that connect what all confirmed links connect; None without any candidate."""
    count = live.count()
    if not count:
        return None
    # The full sets of the classes that may match. Their ids are broadcast up to a bound, and joined beyond it.
    wanted = live.select(F.col("node").alias("id"))
    texts = docs.join(F.broadcast(wanted) if count <= BROADCAST_IDS else wanted, "id", "left_semi")
    sets = sets_of(texts)
    if repeated:  # equal rows of one id
        sets = sets.withColumn("d", F.xxhash64("shingles")).dropDuplicates(["node", "d"]).drop("d")
    sets = store(sets, "sets")
    weight = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x["df"])
    postings = live.select("node", weight.alias("weight"), F.explode(F.slice("tokens", 1, F.size("tokens") - matches + 1)).alias("t")).select("node", "weight", F.col("t.token").alias("token"))
    # Written, so that the join below has nothing but its two sides and a hot token's postings may be split.
    pivots = postings.groupBy("token").agg(F.max(F.struct("weight", -F.col("node"))).alias("p"), F.count("*").alias("n")).where("n > 1")
    pivots = store(pivots.select("token", (-F.col("p.col2")).alias("pivot")), "pivots")
    pairs = postings.join(pivots, "token").where("node <> pivot").select("node", "pivot").distinct()
    tokens = live.select("node", F.transform("tokens", lambda t: t["token"]).alias("tokens"))
    pairs = pairs.join(tokens, "node").join(tokens.toDF("pivot", "pivot_tokens"), "pivot").where(F.size(F.array_intersect("tokens", "pivot_tokens")) >= matches).select("node", "pivot")
    near = pairs.join(sets, "node").join(sets.toDF("pivot", "pivot_shingles"), "pivot")
    near = near.select("node", "pivot", F.size("shingles").alias("x"), F.size("pivot_shingles").alias("y"), F.size(F.array_intersect("shingles", "pivot_shingles")).alias("c"))
    links = store(near.where(_linked(F.col("c"), F.col("x"), F.col("y"), percent)).select(F.col("node").alias("a"), F.col("pivot").alias("b")), "links")
    comps = connected_components(links)

    state = store(live.select("node", "tokens").join(comps, "node", "left").select("node", F.coalesce("component", "node").alias("comp"), "tokens"), "state")
    met = store(_collisions(state, matches, block_rows), "met")
    clusters = connected_components(met.select(F.col("comp").alias("a"), F.col("other").alias("b")).where("a <> b").distinct())
    of_comp = clusters.select(F.col("node").alias("comp"), F.col("component").alias("cluster"))
    members = met.select("node", "comp").distinct().join(of_comp, "comp", "left").select("node", "comp", F.coalesce("cluster", "comp").alias("cluster"))
    by_comp = members.join(sets.select("node", (8 * F.size("shingles")).cast("long").alias("bytes")), "node").groupBy("cluster", "comp").agg(F.count("*").alias("size"), F.sum("bytes").alias("bytes"))
    sizes = by_comp.groupBy("cluster").agg(F.sum("size").alias("size"), F.sum("bytes").alias("bytes"), F.max(F.struct("size", -F.col("comp"), "bytes")).alias("m"))
    blocks = lambda n, b: F.greatest(F.ceil(n / block_rows), F.ceil(b / BLOCK_BYTES), F.lit(1)).cast("int")
    rest = blocks(F.col("size") - F.col("m.size"), F.col("bytes") - F.col("m.bytes"))
    sizes = sizes.select("cluster", (-F.col("m.col2")).alias("main"), blocks(F.col("size"), F.col("bytes")).alias("blocks"), rest.alias("rest_blocks"))
    rows = members.join(sizes, "cluster").join(sets, "node").withColumn("residual", F.col("comp") != F.col("main"))
    more = _dealt(rows, ["cluster"], ["node", "comp", "residual", "shingles"]).groupBy("cluster", "r", "b").applyInArrow(_compare(percent), "a long, b long")
    return links.unionByName(store(more, "more"))


def _dealt(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows (with residual, and the numbers of blocks and rest_blocks) dealt to pairs (r, b): the residual rows of block r beside all rows of block b."""
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    wanted = [*keys, "r", "b", "residual_side", *columns]
    own = rows.where("residual").select("*", place("rest_blocks").alias("r"), each("blocks").alias("b"), F.lit(True).alias("residual_side")).select(wanted)
    across = rows.select("*", place("blocks").alias("b"), each("rest_blocks").alias("r"), F.lit(False).alias("residual_side")).select(wanted)
    return own.unionByName(across)


def _lists(state: DataFrame, matches: int, block_rows: int) -> DataFrame:
    """Posting lists that hold several components, dealt to pairs of blocks."""
    prefix = F.slice("tokens", 1, F.size("tokens") - matches + 1)
    postings = state.select("node", "comp", F.explode(prefix).alias("t")).select("node", "comp", F.col("t.token").alias("token"))
    by_comp = postings.groupBy("token", "comp").agg(F.count("*").alias("size"))
    lists = by_comp.groupBy("token").agg(F.sum("size").alias("size"), F.count("*").alias("comps"), F.max(F.struct("size", -F.col("comp"))).alias("m")).where("comps > 1 and size > 2")
    # In a list of two the only pair has been compared with its pivot. Written, so that the joins below may be split.
    blocks = lambda n: F.ceil(n / block_rows).cast("int")
    lists = store(lists.select("token", (-F.col("m.col2")).alias("main"), blocks(F.col("size")).alias("blocks"), blocks(F.col("size") - F.col("m.size")).alias("rest_blocks")), "lists")
    rows = postings.join(lists, "token").join(state.select("node", F.transform("tokens", lambda t: t["token"]).alias("tokens")), "node")
    return _dealt(rows.withColumn("residual", F.col("comp") != F.col("main")), ["token"], ["node", "comp", "residual", "tokens"])


def _collisions(state: DataFrame, matches: int, block_rows: int) -> DataFrame:
    """(node, comp, other): classes that share `matches` tokens with a class of another component, and a component theirs is tied to, so that
    (comp, other) connect all that collide; never more rows than the lists have. state: node, comp, tokens (rarest first)."""
    return _lists(state, matches, block_rows).groupBy("token", "r", "b").applyInArrow(_collide(matches), "node long, comp long, other long").distinct()


def link_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    plain = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return classes_of(plain, **options)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay: the document of smallest id of each component, and rows without an id."""
    gone = store(link_near_duplicates(docs, id_col, text_col, **options).where(~F.col("kept")).select(F.col("id").alias("__pl_gone")).distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs[id_col].cast("long") == F.col("__pl_gone"), "left_anti")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link_near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
QUERIES = {"op6_near_dedup": op6_near_dedup}
ORACLES = {
    "op6_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_W} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT w.doc_id, count(s.k) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id, doc_id AS o FROM n UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.o),
m AS (SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN m USING (doc_id)"""
}
