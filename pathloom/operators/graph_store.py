"""The stored graph: nodes and edges as tables, loaded in full or file by file.

Every step gives new frames; they are written beside the old ones, and then a version names the folders that are in use, so
a table is never overwritten while it is read and a lost job leaves the old graph in place.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.tables import discard, written

NODE_SCHEMA = (
    "node_id string, file_path string, function_name string, line_start int, line_end int, node_type string, code string, content_hash string, run_id string, repo_id string"
)
EDGE_SCHEMA = "src string, dst string, type string, summary boolean, resolved_virtual boolean"


def normalise_nodes(nodes: DataFrame, repo: str, run: str) -> DataFrame:
    """Raw nodes with defaults for missing values, a global id and a content hash. seq orders rows of equal id."""
    text = lambda c, other="": F.coalesce(F.col(c), F.lit(other))
    local = F.coalesce("node_id", F.sha2(F.concat_ws(":", text("file_path"), text("node_type", "AST_FUNC"), text("function_name"), F.coalesce("line_start", F.lit(0)).cast("string")), 256))
    rows = nodes.select(
        local.alias("local_id"), text("file_path").alias("file_path"), text("function_name").alias("function_name"), F.coalesce("line_start", F.lit(0)).cast("int").alias("line_start"),
        F.coalesce("line_end", F.lit(0)).cast("int").alias("line_end"), text("node_type", "AST_FUNC").alias("node_type"), text("code").alias("code"),
        F.col("seq") if "seq" in nodes.columns else F.monotonically_increasing_id().alias("seq"),
    )
    return rows.withColumns(
        {"node_id": F.sha2(F.concat_ws(":", F.lit(repo), "file_path", "local_id"), 256), "content_hash": F.sha2("code", 256), "run_id": F.lit(run), "repo_id": F.lit(repo)}
    )


def latest(rows: DataFrame, key: list[str], seq: str | Column, first: bool = False) -> DataFrame:
    """The row of the greatest seq of each key (of the least, if `first`). Each task sends one row a key on, so no key is hot."""
    order = F.col(seq) if isinstance(seq, str) else seq
    pick = F.min_by if first else F.max_by
    return rows.groupBy(*key).agg(pick(F.struct(*[F.col(c) for c in rows.columns]), order).alias("__row")).select("__row.*")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new, and rows of old with another key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def purge(nodes: DataFrame, repo: str, run: str) -> DataFrame:
    """nodes without those that the repository had before this run."""
    return nodes.where((F.col("repo_id") != repo) | (F.col("run_id") == run))


def live_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist."""
    ids = nodes.select("node_id")
    return edges.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi")


def remap(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edge ends by ids (local_id, node_id, and seq if there are rows of equal local id: the last one counts); an end that
    is not there keeps its own id. Edges with a file_path are mapped inside their file if ids have one too."""
    both = "file_path" in edges.columns and "file_path" in ids.columns
    ids = ids.groupBy(*["file_path"] * both, "local_id").agg((F.max_by("node_id", "seq") if "seq" in ids.columns else F.max("node_id")).alias("node_id"))
    if both:
        a, b = ids.toDF("file_path", "src", "__s"), ids.toDF("file_path", "dst", "__d")
        out = edges.join(a, ["file_path", "src"], "left").join(b, ["file_path", "dst"], "left")
        return out.withColumns({"src": F.coalesce("__s", "src"), "dst": F.coalesce("__d", "dst")}).drop("__s", "__d", "file_path")
    a, b = ids.toDF("src", "__s"), ids.toDF("dst", "__d")
    out = edges.join(a, "src", "left").join(b, "dst", "left")
    return out.withColumns({"src": F.coalesce("__s", "src"), "dst": F.coalesce("__d", "dst")}).drop("__s", "__d")


def clean_edges(edges: DataFrame) -> DataFrame:
    """Non-empty ends, type in capitals (CALL where missing), one row per identity."""
    kept = edges.where("coalesce(src, '') <> '' and coalesce(dst, '') <> ''")
    flag = lambda c: F.col(c).cast("boolean") if c in edges.columns else F.lit(None).cast("boolean")
    return kept.select("src", "dst", F.upper(F.coalesce("type", F.lit("CALL"))).alias("type"), flag("summary").alias("summary"), flag("resolved_virtual").alias("resolved_virtual")).distinct()


def write_edges(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges to keep, pairs offered per type): the count is of what was offered, whether or not its ends exist."""
    clean = clean_edges(edges)
    return live_edges(clean, nodes), clean.groupBy("type").agg(F.count("*").alias("offered"))


def replace_files(nodes: DataFrame, new: DataFrame, changed: DataFrame, repo: str) -> DataFrame:
    """nodes with those of changed files (file_path) of a repository replaced by new; a changed file without new nodes is gone."""
    stale = changed.select("file_path").distinct().withColumn("repo_id", F.lit(repo))
    return nodes.join(stale, ["file_path", "repo_id"], "left_anti").unionByName(new, allowMissingColumns=True)


def group_by_backend(files: DataFrame) -> DataFrame:
    """Files (file_path, backend, n_nodes) by backend: how many, and their created nodes."""
    return files.groupBy("backend").agg(F.count("*").alias("n_files"), F.sum("n_nodes").alias("nodes_created"))


def node_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both by node_id: state (created, updated, unchanged, gone), and `row`, the one that is to stay (of gone ones the old one).

    A node is unchanged if its content hash and all else but its run are; it keeps the row it had.
    """
    columns = [f.split()[0] for f in NODE_SCHEMA.split(", ")]
    told = [c for c in columns if c != "run_id"]
    side = lambda rows, name: rows.groupBy("node_id").agg(F.max(F.struct(*columns)).alias(name))
    both = side(old, "was").join(side(new, "now"), "node_id", "full")
    same = F.struct(*[F.col(f"was.{c}") for c in told]).eqNullSafe(F.struct(*[F.col(f"now.{c}") for c in told]))
    state = F.when(F.col("was").isNull(), "created").when(F.col("now").isNull(), "gone").when(same, "unchanged").otherwise("updated")
    return both.select("node_id", state.alias("state"), F.when(F.col("now").isNull() | same, F.col("was")).otherwise(F.col("now")).alias("row"))


def detach(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """edges that have no end among ids (node_id)."""
    return edges.join(ids.toDF("src"), "src", "left_anti").join(ids.toDF("dst"), "dst", "left_anti")


#: The tables of a store, and what tells a row's bucket.
KINDS = {"nodes": NODE_SCHEMA, "ids": "node_id string, at int", "edges": f"{EDGE_SCHEMA}, near int, far int", "incoming": f"{EDGE_SCHEMA}, near int, far int"}


@dataclass
class GraphStore:
    """A graph at `path`, in buckets, and its versions.

    Nodes lie in the bucket of their file. `ids` is an index: each node's bucket, by a hash of its id. Edges are placed twice, in the bucket of
    their source's file (`edges`) and in that of their far end's (`incoming`), and each has both buckets (near, far). So all edges at
    a file are found in the buckets of that file, and an id is looked up in one bucket.

    A version is a list of the bucket folders that it consists of; a load of changed files reads and writes only buckets
    in which something changes, and shares the rest with the version before. `buckets` is fixed by the first version.
    """

    spark: SparkSession
    path: str
    buckets: int = 256

    def _fs(self, at: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """Number of the current version; 0 if the graph is empty."""
        fs, p = self._fs(f"{self.path}/versions")
        if not fs.exists(p):
            return 0
        return max((int(s.getPath().getName()[1:]) for s in fs.listStatus(p) if s.getPath().getName()[0] == "v"), default=0)

    def _told(self, n: int) -> dict:
        if not n:
            return {}
        fs, p = self._fs(f"{self.path}/versions/v{n}")
        stream = fs.open(p)
        told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        return told

    def _parts(self, n: int) -> dict[str, dict[int, str]]:
        """The folders of a version: of each table, bucket to path below the store."""
        told = self._told(n)
        self.buckets = told.get("buckets", self.buckets)
        return {kind: {int(k): at for k, at in told.get(kind, {}).items()} for kind in KINDS}

    def last_batch(self, source: str) -> int:
        """Number of the last batch of a source that the current version holds; -1 if none."""
        return self._told(self.version()).get("batches", {}).get(source, -1)

    def _read(self, kind: str, parts: dict[str, dict[int, str]], only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{at}" for k, at in sorted(parts[kind].items()) if only is None or k in only]
        return self.spark.read.schema(KINDS[kind]).parquet(*paths) if paths else self.spark.createDataFrame([], KINDS[kind])

    def load(self) -> tuple[DataFrame, DataFrame]:
        parts = self._parts(self.version())
        return self._read("nodes", parts), self._read("edges", parts).drop("near", "far")

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _number(self, key: str) -> int:
        return self.spark.sql("SELECT pmod(xxhash64(:key), :n)", {"key": key, "n": self.buckets}).first()[0]

    def _placed(self, edges: DataFrame, ids: DataFrame) -> DataFrame:
        """Edges whose ends both exist, with their buckets. ids: node_id, at."""
        placed = edges.join(ids.toDF("src", "near"), "src").join(ids.toDF("dst", "far"), "dst")
        return placed.select(*[f.split()[0] for f in KINDS["edges"].split(", ")])

    def _write(self, kind: str, own: str, rows: DataFrame) -> dict[int, str]:
        """rows in their buckets below data/own: the folders made. A bucket too large for one task is split over several."""
        place, order = {"nodes": (self._bucket("file_path"), ["repo_id", "file_path"]), "ids": (self._bucket("node_id"), ["node_id"]), "edges": (F.col("near"), ["src"]), "incoming": (F.col("far"), ["dst"])}[kind]
        columns, at = [f.split()[0] for f in KINDS[kind].split(", ")], f"data/{own}/{kind}"
        rows = rows.select(*columns, place.alias("bucket")).hint("rebalance", "bucket").sortWithinPartitions("bucket", *order)
        rows.write.partitionBy("bucket").parquet(f"{self.path}/{at}")
        fs, p = self._fs(f"{self.path}/{at}")
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return {int(name.partition("=")[2]): f"{at}/{name}" for name in names if name.startswith("bucket=")}

    def _rewrite(self, kind: str, own: str, parts: dict[str, dict[int, str]], touched: set[int], rows: DataFrame) -> dict[int, str]:
        """The folders of a table whose touched buckets hold rows from now on."""
        return {k: at for k, at in parts[kind].items() if k not in touched} | (self._write(kind, own, rows) if touched else {})

    def save(self, nodes: DataFrame, edges: DataFrame, keep: int = 2, batch: tuple[str, int] | None = None) -> int:
        """Write all of a graph (edges whose ends exist) as a version and point to it; of older ones `keep` stay, for readers that began before. Of two
        writers at once the later one fails and may try again on what the other wrote."""
        n, own = self.version() + 1, uuid.uuid4().hex
        self._parts(n - 1)
        made = {"nodes": self._write("nodes", own, nodes)}
        ids = self._read("nodes", made).select("node_id", self._bucket("file_path").alias("at")).dropDuplicates(["node_id"])
        made["ids"] = self._write("ids", own, ids)
        made["edges"] = self._write("edges", own, self._placed(edges, self._read("ids", made)))
        made["incoming"] = self._write("incoming", own, self._read("edges", made))
        return self._point(n, made, keep, batch)

    def replace(self, new: DataFrame, offered: DataFrame, changed: DataFrame, repo: str, keep: int = 2, batch: tuple[str, int] | None = None) -> dict[str, int]:
        """A version in which the nodes of changed files (file_path) of a repository are new: the number of nodes of each state.

        All edges at nodes that these files had go, those from and to other files as well; those offered whose ends exist come. A node that is as
        it was keeps its row, and an edge that goes and comes again is no change. Only buckets in which something differs are written.
        """
        n, own = self.version() + 1, uuid.uuid4().hex
        parts = self._parts(n - 1)
        numbers = lambda rows, c: {r[0] for r in rows.select(c).distinct().collect()}
        stale = changed.select("file_path").distinct().withColumn("repo_id", F.lit(repo))
        dirty = numbers(stale, self._bucket("file_path"))
        there = self._read("nodes", parts, dirty)
        changes = written(node_changes(there.join(stale, ["file_path", "repo_id"], "left_semi"), new), "changes")
        states = changes.groupBy("state", self._bucket("row.file_path").alias("bucket")).count().collect()
        count = {state: sum(r["count"] for r in states if r.state == state) for state in ("created", "updated", "unchanged", "gone")}
        differ = {r.bucket for r in states if r.state != "unchanged"}
        stays = there.where(self._bucket("file_path").isin(differ)).join(stale, ["file_path", "repo_id"], "left_anti")
        now = changes.where("state <> 'gone'").select("row.*").where(self._bucket("file_path").isin(differ))
        made = {"nodes": self._rewrite("nodes", own, parts, differ, stays.unionByName(now))}

        was = changes.where("state <> 'created'").select("node_id")
        less, more = changes.where("state = 'gone'").select("node_id"), changes.where("state = 'created'").select("node_id", self._bucket("row.file_path").alias("at"))
        touched = numbers(changes.where("state in ('created', 'gone')"), self._bucket("node_id"))
        ids = self._read("ids", parts, touched).join(less, "node_id", "left_anti").unionByName(more)
        made["ids"] = self._rewrite("ids", own, parts, touched, ids)

        ends = written(offered.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct(), "ends")
        known = self._read("ids", made, numbers(ends, self._bucket("node_id"))).join(ends, "node_id", "left_semi")
        come = written(self._placed(offered, known).distinct(), "come")
        lost = self._read("edges", parts, dirty).join(was.toDF("src"), "src", "left_semi").unionByName(self._read("incoming", parts, dirty).join(was.toDF("dst"), "dst", "left_semi")).distinct()
        # Of all edges that go or come, those that do only one of the two.
        sides = come.withColumn("side", F.lit(1)).unionByName(lost.withColumn("side", F.lit(-1)))
        moved = written(sides.groupBy(*come.columns).agg(F.sum("side").alias("side")).where("side <> 0"), "moved")
        for kind, place in (("edges", "near"), ("incoming", "far")):
            touched = numbers(moved, place)
            kept = detach(self._read(kind, parts, touched), was)
            made[kind] = self._rewrite(kind, own, parts, touched, kept.unionByName(come.where(F.col(place).isin(touched))).distinct())
        self._point(n, made, keep, batch)
        discard(changes, ends, come, moved)
        return count

    def _point(self, n: int, parts: dict[str, dict[int, str]], keep: int, batch: tuple[str, int] | None) -> int:
        batches = self._told(n - 1).get("batches", {}) | (dict([batch]) if batch else {})
        fs, p = self._fs(f"{self.path}/versions/v{n}")
        try:
            out = fs.create(p, False)
        except Py4JJavaError as e:
            raise RuntimeError(f"version {n} of {self.path} was written by another writer") from e
        out.write(bytearray(json.dumps({"buckets": self.buckets, "batches": batches, **parts}).encode()))
        out.close()
        used = {at for v in range(max(n - keep, 1), n + 1) for kind in self._parts(v).values() for at in kind.values()}
        for old in range(n - keep - 1, 0, -1):
            fs, p = self._fs(f"{self.path}/versions/v{old}")
            if not fs.exists(p):
                break
            for at in {at for kind in self._parts(old).values() for at in kind.values()} - used:
                fs.delete(self._fs(f"{self.path}/{at}")[1], True)
            fs.delete(p, False)
        return n

    def has(self, repo: str) -> bool:
        return not self.load()[0].where(F.col("repo_id") == repo).isEmpty()

    def node(self, node_id: str) -> DataFrame:
        """The node of an id: its bucket by the index, then that bucket."""
        parts = self._parts(self.version())
        at = self._read("ids", parts, {self._number(node_id)}).where(F.col("node_id") == node_id).select("at").first()
        return self._read("nodes", parts, {at.at} if at else set()).where(F.col("node_id") == node_id)

    def nodes_of(self, file_path: str) -> DataFrame:
        """Nodes of a file, read from its bucket alone."""
        return self._read("nodes", self._parts(self.version()), {self._number(file_path)}).where(F.col("file_path") == file_path)

    def edges_into(self, file_path: str) -> DataFrame:
        """Edges that end at nodes of a file, read from its bucket alone."""
        parts = self._parts(self.version())
        return self._read("incoming", parts, {self._number(file_path)}).join(self.nodes_of(file_path).select(F.col("node_id").alias("dst")), "dst", "left_semi").drop("near", "far")

    def ingest(self, nodes: DataFrame, edges: DataFrame, repo: str, run: str, changed: DataFrame | None = None, full: bool = False, batch: tuple[str, int] | None = None) -> dict[str, object]:
        """Load raw nodes and edges of a repository: all of it at first or if `full`, else only the changed files.

        batch: (source, number); a number not above the last one that the graph holds of this source changes nothing.
        """
        told = dict.fromkeys(("nodes_created", "nodes_updated", "nodes_unchanged", "edges_created"), 0)
        if batch and batch[1] <= self.last_batch(batch[0]):
            return {**told, "ingestion_mode": "repeated"}
        full = full or changed is None or not self.has(repo)
        raw = written(latest(normalise_nodes(nodes, repo, run), ["node_id"], "seq"), "nodes")
        clean = written(clean_edges(remap(edges, raw.select("file_path", "local_id", "node_id", "seq"))), "offered")
        new = raw.drop("local_id", "seq")
        if full:
            old_nodes, old_edges = self.load()
            own = old_nodes.where(F.col("repo_id") == repo)
            count = {r.state: r["count"] for r in node_changes(own, new).groupBy("state").count().collect()}
            every = purge(upsert(old_nodes, new, ["node_id"]), repo, run)
            self.save(every, old_edges.unionByName(clean).distinct(), batch=batch)
        else:
            new = new.join(changed.select("file_path").distinct(), "file_path", "left_semi")
            count = self.replace(new, clean, changed, repo, batch=batch)
        told |= {f"nodes_{state}": count.get(state, 0) for state in ("created", "updated", "unchanged")} | {"edges_created": clean.count()}
        discard(raw, clean)
        return {**told, "ingestion_mode": "full" if full else "incremental"}
