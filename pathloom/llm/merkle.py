"""Operator 13: a Merkle manifest of a dataset, kept as a node store on disk, with proofs and their checks.

Every row is a leaf: the digest of its fields. Per group (source) leaves ascend by id; each three neighbours become the digest of
their digests, level by level, until one node is left, the group's root; the groups' roots, in their order, do the same.

Leaves are range-sorted by group and id and written as sorted runs; a run's place among the others (a count per run and group) gives
each leaf its coordinate, so no group ever has to be in one task. Nodes lie in Parquet, partitioned by tree and level, under their
coordinates (group, level, idx). A pass reads one level in stretches of 3^STRIDE neighbouring nodes, each stretch in order, and writes the
levels above it, each from the one before; the next pass begins with the highest of these. Proofs come down the same way: a
pass scans, side by side and by coordinate, the nodes of a stretch's levels and what is asked of it, and hands each node its siblings
and what its stretch has from above. Neither a level nor a group is ever held whole; a task holds a stretch at a time.

Null fields count as `-`. Null groups are a group, the first; rows of a null id come first in theirs, equal ids are ordered by their
leaves; repeated rows are leaves each. Texts of any length are digested whole. A group of one leaf has that leaf as its root; an
empty table has no root and gives no rows. Only the named columns are read, whatever others are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import discard, scratch, ship, store

#: Nodes that become one.
FANOUT = 3
#: Levels written by one pass; a stretch has FANOUT ** STRIDE nodes at most.
STRIDE = 7
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
NODE = "grp string, idx long, size long, digest binary, tree string, level int"
_RUN_BITS = 33


def joined(digests: list[str]) -> str:
    """The digest of digests, taken as hex text."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf_digest(values: list[Column]) -> Column:
    """Hex digest of each value as its UTF-8 byte count, `:` and itself, or `-` where it is null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with idx, its place in its grp by order, and size, the number of rows of the grp; written as sorted runs."""
    runs = store(rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("at", F.monotonically_increasing_id()), name)
    run, pos = F.shiftright("at", _RUN_BITS), F.col("at").bitwiseAND((1 << _RUN_BITS) - 1)
    spans = runs.groupBy(run.alias("run"), F.col("grp").alias("of")).agg(F.min(pos).alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy("of")
    spans = spans.select("run", "of", (F.sum("n").over(own.orderBy("run")) - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(own).alias("size"))
    return runs.join(spans, (run == spans["run"]) & (F.col("grp") == spans["of"])).select(*rows.columns, (pos + F.col("shift")).alias("idx"), "size")


@dataclass
class Manifest:
    """leaves: row per leaf (id, leaf and claim as bytes, grp, idx, size). path: the node store. root: hex, None of an empty table."""

    leaves: DataFrame
    path: str
    root: str | None
    stride: int = STRIDE

    def nodes(self, tree: str) -> DataFrame:
        return self.leaves.sparkSession.read.schema(NODE).parquet(self.path).where(F.col("tree") == tree)


def _levels(stretch: pa.Table, stride: int) -> pa.Table:
    """The nodes of all levels above a stretch of neighbours, as far as the pass goes."""
    order = np.argsort(stretch["idx"].to_numpy())
    level, first, size = stretch["level"][0].as_py(), int(stretch["idx"][int(order[0])].as_py()), stretch["size"][0].as_py()
    now = [d.hex() for d in stretch["digest"].take(pa.array(order)).to_pylist()]
    goes_on = size > FANOUT**stride
    out: list[tuple[int, int, int, bytes]] = []
    for _ in range(stride):
        if not goes_on and len(now) == 1:
            break
        now = [joined(now[i : i + FANOUT]) for i in range(0, len(now), FANOUT)]
        level, first, size = level + 1, first // FANOUT, -(-size // FANOUT)
        out.extend((first + i, size, bytes.fromhex(d), level) for i, d in enumerate(now))
    idx, sizes, digests, levels = zip(*out, strict=True)
    n = len(out)
    return pa.table(
        {"grp": pa.array([stretch["grp"][0].as_py()] * n), "idx": pa.array(idx, pa.int64()), "size": pa.array(sizes, pa.int64()), "digest": pa.array(digests, pa.binary()), "tree": pa.array([stretch["tree"][0].as_py()] * n), "level": pa.array(levels, pa.int32())}
    )


def _grow(spark: SparkSession, path: str, tree: str, stride: int) -> int:
    """Write all levels of a tree above its level 0; the level at which the last pass began."""
    base = 0
    while True:
        below = spark.read.schema(NODE).parquet(path).where((F.col("tree") == tree) & (F.col("level") == base) & (F.col("size") > 1))
        if below.isEmpty():
            return max(0, base - stride)
        stretch = F.floor(F.col("idx") / FANOUT**stride).alias("stretch")
        above = below.groupBy("grp", stretch).applyInArrow(lambda t: _levels(t, stride), NODE)
        above.write.mode("append").partitionBy("tree", "level").parquet(path)
        base += stride


def build(docs: DataFrame, fields: list[str] = FIELDS, group_col: str = "source", id_col: str = "doc_id", claim: Column | None = None, path: str | None = None, stride: int = STRIDE) -> Manifest:
    """The manifest of docs, its nodes under path. claim: a digest (hex, or null) to be checked against the row's place later."""
    spark = docs.sparkSession
    ship(spark)
    path = path or scratch(spark, "merkle")
    # `:` and the name sort as the names do, after the null group's `-`.
    grp = F.coalesce(F.concat(F.lit(":"), docs[group_col].cast("string")), F.lit("-"))
    leaves = docs.select(
        grp.alias("grp"), docs[id_col].cast("long").alias("id"), F.unhex(leaf_digest([docs[c] for c in fields])).alias("leaf"),
        (F.unhex(claim) if claim is not None else F.lit(None).cast("binary")).alias("claim"), F.monotonically_increasing_id().alias("row"),
    )
    # Rows are numbered where they are written, so that equal ones may be parted and come out the same again.
    unsorted = store(leaves, "leaves")
    leaves = numbered(unsorted, ["id", "leaf", "row"], "leaf-runs").drop("row")
    discard(unsorted)
    leaves.select("grp", "idx", "size", F.col("leaf").alias("digest"), F.lit("rows").alias("tree"), F.lit(0).alias("level")).write.partitionBy("tree", "level").parquet(path)
    _grow(spark, path, "rows", stride)
    subroots = spark.read.schema(NODE).parquet(path).where("tree = 'rows' and size = 1").select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
    groups = numbered(subroots, ["name"], "subroots")
    groups.select("grp", "idx", "size", "digest", F.lit("groups").alias("tree"), F.lit(0).alias("level")).write.mode("append").partitionBy("tree", "level").parquet(path)
    _grow(spark, path, "groups", stride)
    top = spark.read.schema(NODE).parquet(path).where("tree = 'groups' and size = 1").first()
    return Manifest(leaves, path, top and bytes(top.digest).hex(), stride)


def steps(proof: bytes) -> list[tuple[int, list[str]]]:
    """A proof from the leaf up: per level the node's place among its run, and the run's others as hex."""
    out, at = [], 0
    while at < len(proof):
        place, others = divmod(proof[at], 4)
        out.append((place, [proof[at + 1 + 32 * i : at + 33 + 32 * i].hex() for i in range(others)]))
        at += 1 + 32 * others
    return out


def folded(leaf: str, proof: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf has by its proof."""
    for place, others in proof:
        leaf = joined([*others[:place], leaf, *others[place:]])
    return leaf


_ASKED = "grp string, idx long, id long, claim binary, leaf binary, subroot binary, proof binary"


def _hand_down(base: int, stride: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda nodes, asked: _handed_down(nodes, asked, base, stride)


def _handed_down(nodes: pa.Table, asked: pa.Table, base: int, stride: int) -> pa.Table:
    """Of one stretch: what is asked of it, with proofs. nodes: its levels from base up, and one row of level -1 with what its top has."""
    level, idx, digest = nodes["level"].to_numpy(), nodes["idx"].to_numpy(), nodes["digest"]
    above = int(np.flatnonzero(level == -1)[0])
    upper, subroot = nodes["proof"][above].as_py(), digest[above].as_py()
    held: list[list[bytes]] = []
    firsts: list[int] = []
    for k in range(stride):
        own = np.flatnonzero(level == base + k)
        if not len(own):
            break
        own = own[np.argsort(idx[own])]
        held.append(digest.take(pa.array(own)).to_pylist())
        firsts.append(int(idx[own[0]]))
        if nodes["size"][int(own[0])].as_py() == 1:
            held.pop()
            break
    # From the top down: the proof of each node of a level is its run's others and the proof of the node above.
    proofs = [upper]
    for k in range(len(held) - 1, -1, -1):
        now, below = held[k], []
        for i in range(len(now)):
            run = i - i % FANOUT
            others = now[run:i] + now[i + 1 : run + FANOUT]
            below.append(b"".join([bytes([4 * (i - run) + len(others)]), *others, proofs[i // FANOUT]]))
        proofs = below
    first = firsts[0] if firsts else 0
    at = [i - first for i in asked["idx"].to_pylist()]
    n = len(at)
    leaves = held[0] if held else [digest[int(np.flatnonzero(level == base)[0])].as_py()]
    return asked.select(["grp", "idx", "id", "claim"]).append_column("leaf", pa.array([leaves[i] for i in at], pa.binary())).append_column("subroot", pa.array([subroot] * n, pa.binary())).append_column("proof", pa.array([proofs[i] for i in at], pa.binary()))


def _proofs(manifest: Manifest, tree: str, roots: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (grp, idx, id, claim: rows of level 0 of the tree) with leaf, subroot and proof. roots: (grp, top, subroot, proof) per grp, top being its root's level."""
    stride, span = manifest.stride, FANOUT**manifest.stride
    nodes = manifest.nodes(tree)
    highest = roots.agg(F.max("top")).first()[0] or 0
    handed: DataFrame | None = None
    for base in range(max(0, -(-highest // stride) - 1) * stride, -1, -stride):
        ends_here = (F.col("top") > base) & (F.col("top") <= base + stride) if base else F.col("top") <= stride
        uppers = roots.where(ends_here).select("grp", F.lit(0).cast("long").alias("stretch"), "subroot", "proof")
        if handed is not None:
            uppers = uppers.unionByName(handed.select("grp", F.col("idx").alias("stretch"), "subroot", "proof"))
        # Level base + k of a stretch has its nodes at idx div 3^(stride - k); a lone leaf's group has level 0 alone.
        scale = F.pow(F.lit(float(FANOUT)), F.lit(stride + base) - F.col("level"))
        part = nodes.where(F.col("level").between(base, base + stride - 1) & ((F.col("size") > 1) | (F.col("level") == 0) | (F.col("level") > base)))
        part = part.select("grp", F.floor(F.col("idx") / scale).alias("stretch"), "level", "idx", "size", "digest", F.lit(None).cast("binary").alias("proof"))
        rows = part.unionByName(uppers.select("grp", "stretch", F.lit(-1).alias("level"), F.lit(-1).cast("long").alias("idx"), F.lit(0).cast("long").alias("size"), F.col("subroot").alias("digest"), "proof"))
        want = asked if not base else nodes.where((F.col("level") == base) & (F.col("size") > 1)).select("grp", "idx", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("claim"))
        want = want.withColumn("stretch", F.floor(F.col("idx") / span))
        handed = rows.groupBy("grp", "stretch").cogroup(want.groupBy("grp", "stretch")).applyInArrow(_hand_down(base, stride), _ASKED)
        if base:
            handed = store(handed, "proofs")
    return handed


def proofs(manifest: Manifest) -> DataFrame:
    """Per leaf: grp, idx, id, claim, leaf, subroot (of its group) and proof (see steps)."""
    tops = manifest.nodes("rows").where("size = 1").select("grp", F.col("level").alias("top"), F.col("digest").alias("subroot"))
    names = numbered(tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "top", "subroot"), ["name"], "named-subroots")
    names = store(names, "groups")
    root = manifest.nodes("groups").where("size = 1").select("grp", F.col("level").alias("top"), F.col("digest").alias("subroot"), F.lit(b"").alias("proof"))
    asked = names.select("grp", "idx", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("claim"))
    of_groups = _proofs(manifest, "groups", root, asked).select("idx", "proof")
    roots = names.select("idx", F.col("name").alias("grp"), "top", "subroot").join(of_groups, "idx").drop("idx")
    return _proofs(manifest, "rows", store(roots, "group-proofs"), manifest.leaves.select("grp", "idx", "id", "claim"))


def checked(manifest: Manifest) -> DataFrame:
    """Per leaf, in hex: doc_id, leaf, subroot, root, proof_sha256 (of the siblings from the leaf up), folded_root (of the claim, if any, else the leaf) and whether that is the root."""
    root = manifest.root
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for claim, leaf, subroot, proof in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3, 4)], strict=True):
                path = steps(proof)
                found = folded((claim or leaf).hex(), path)
                rows.append((leaf.hex(), subroot.hex(), root, joined([d for _, others in path for d in others]), found, found == root))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string()) for c in columns[:5]], pa.array(columns[5], pa.bool_())], names=names)

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return proofs(manifest).select("id", "claim", "leaf", "subroot", "proof").mapInArrow(work, schema)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' proofs, checked against copies of which every second one (by id) has lost its line ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut = [F.replace(docs[c], F.lit("\n"), F.lit("")) if c == "text" else docs[c] for c in FIELDS]
    claim = F.when(F.crc32(docs["doc_id"].cast("string")) % 2 == 0, leaf_digest(cut))
    return checked(build(docs, claim=claim))


QUERIES = {"op13_merkle": op13_merkle}
# crc32 bit by bit over the id's digits; only its last bit is needed.
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || {v}, '-')" for v in ["doc_id", "source", "lang", "n_chars", text]) + ")"


def _tree_sql(name: str, base: str) -> str:
    """Levels of trees over `base` (g, i, h), and each leaf's steps up to its root."""
    return f"""
{name} AS (SELECT 0 AS lev, g, i, h, count(*) OVER (PARTITION BY g) AS n FROM {base}
  UNION ALL SELECT lev + 1, g, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3) FROM {name} WHERE n > 1 GROUP BY lev, g, i // 3),
{name}_up AS (SELECT a.lev, a.g, a.i, a.h, a.n, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM {name} a JOIN {name} b ON a.lev = b.lev AND a.g = b.g AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL)"""


ORACLES = {
    "op13_merkle": f"""
WITH RECURSIVE f AS (SELECT doc_id, coalesce(':' || source, '-') AS g, {_leaf_sql("text")} AS leaf, CASE WHEN {_CRC} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS claim FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM f), {_tree_sql("t", "d")},
s AS (SELECT '' AS g, g AS name, row_number() OVER (ORDER BY g) - 1 AS i, h FROM t WHERE n = 1), {_tree_sql("u", "s")},
top AS (SELECT h AS root FROM u WHERE n = 1),
w AS (SELECT 0 AS lev, d.g AS g, d.i AS i, d.g AS og, d.i AS oi, '' AS p, coalesce(claim, leaf) AS x FROM d
  UNION ALL SELECT w.lev + 1, w.g, w.i // 3, og, oi, p || l || r, sha256(l || x || r) FROM w JOIN t_up v ON v.lev = w.lev AND v.g = w.g AND v.i = w.i),
top_of AS (SELECT og, oi, p, x FROM w JOIN t ON t.lev = w.lev AND t.g = w.g AND t.i = w.i AND t.n = 1),
z AS (SELECT 0 AS lev, s.i AS i, og, oi, p, x, s.h AS subroot FROM top_of JOIN s ON s.name = og
  UNION ALL SELECT z.lev + 1, z.i // 3, og, oi, p || l || r, sha256(l || x || r), subroot FROM z JOIN u_up v ON v.lev = z.lev AND v.i = z.i)
SELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, x AS folded_root, x = root AS verified
FROM z JOIN u ON u.lev = z.lev AND u.i = z.i AND u.n = 1 JOIN d ON d.g = og AND d.i = oi, top"""
}
