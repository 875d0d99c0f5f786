"""Bounded source-to-sink search over a property graph.

nodes: node_id, file_path, function_name, line_start, line_end, node_type, code, ...
edges: src, dst, type, and optionally summary, resolved_virtual (flags that are part of an edge's identity).

The search expands all sources together, one join per hop. Before it starts, every node's least distance to a sink is
found backwards, so a partial path goes on only where the hops left still reach one. Each hop is written to the shared
folder. Where only the first paths are asked for, the search is best-first and keeps a fixed number of partial paths a hop.

Edges that every node of one set has to every node of another are given as hubs: an edge in and an edge out of the hub, which
a search steps through as one hop. So m calls of n functions of a name are m + n rows, not m x n.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import catalog
from pathloom.functions.tables import Parts, unsent, written


def source_nodes(nodes: DataFrame, sources: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Nodes that may start a path. sources: `name`. changed: `file_path`; given but empty, nothing starts."""
    kind = F.col("node_type")
    fits = kind.isin(catalog.SOURCE_TYPES) | F.contains(kind, F.lit("SOURCE")) | F.contains(kind, F.lit("CALL"))
    found = nodes.where(fits).join(F.broadcast(sources), nodes["function_name"] == sources["name"], "left_semi")
    return found if changed is None else found.join(changed, "file_path", "left_semi")


def sink_nodes(nodes: DataFrame, sinks: DataFrame) -> DataFrame:
    """Nodes that may end a path; never restricted to changed files."""
    kind = F.col("node_type")
    fits = kind.isin(catalog.SINK_TYPES) | F.contains(kind, F.lit("SINK")) | F.contains(kind, F.lit("CALL"))
    return nodes.where(fits).join(F.broadcast(sinks), nodes["function_name"] == sinks["name"], "left_semi")


@dataclass
class Hubs:
    """Edges from each src of a hub (enter: src, hub) to each dst of it (leave: hub, dst), but those of skip (src, dst) and loops; of one type
    and flags. several: a src and a dst may have several hubs in common, and still have one edge. rest: given where
    enter has a column own, the one dst of the hub that src has already (null: none); what of skip is not told so."""

    enter: DataFrame
    leave: DataFrame
    skip: DataFrame
    type: str = "CALL"
    summary: bool | None = None
    resolved_virtual: bool | None = None
    several: bool = False
    rest: DataFrame | None = None

    def pairs(self) -> DataFrame:
        """The edges one by one: src, dst. Where enter tells what a src has already, they are not shuffled: there may be far more of them than rows given."""
        found = self.enter.join(self.leave, "hub").where("src <> dst")
        if self.rest is None:
            found = found.select("src", "dst")
            return (found.distinct() if self.several else found).join(self.skip, ["src", "dst"], "left_anti")
        found = found.where(~F.col("dst").eqNullSafe(F.col("own"))).select("src", "dst")
        return found if self.rest.isEmpty() else found.join(self.rest, ["src", "dst"], "left_anti")


def nearest_ends(edges: DataFrame, ends: DataFrame, most: int, stride: int = 4, hubs: list[Hubs] = ()) -> DataFrame:
    """(node, dist, end): least hops from each node to any of `ends` (node), up to `most`, and the least of the ends so far away; ends are 0 from themselves.

    Every `stride` hops are one job: what their layers reach is written without the nodes known before, and the nodes
    found in the last layer are where the next job starts. A layer holds each node once, so a job's rows are at most
    `stride` times the nodes, however many paths lead to them. What a hub skips is one edge away anyway.
    """
    known = Parts(edges.sparkSession, "dist")
    frontier, _ = known.add(ends.select("node").distinct().select("node", F.lit(0).alias("dist"), F.col("node").alias("end")))
    for hop in range(0, most, stride):
        last, layers = min(hop + stride, most), []
        layer = frontier.select("node", "end")
        for dist in range(hop + 1, last + 1):
            at = layer.toDF("dst", "end")
            before = edges.join(at, "dst").select("src", "end")
            for h in hubs:
                before = before.unionByName(h.enter.join(h.leave.join(at, "dst").groupBy("hub").agg(F.min("end").alias("end")), "hub").select("src", "end"))
            layer = before.groupBy(F.col("src").alias("node")).agg(F.min("end").alias("end"))
            layers.append(layer.select("node", F.lit(dist).alias("dist"), "end"))
        reached = reduce(DataFrame.unionByName, layers).groupBy("node").agg(F.min(F.struct("dist", "end")).alias("m")).select("node", "m.*")
        new, seen = known.add(reached.join(known.read().select("node"), "node", "left_anti"), last=F.count_if(F.col("dist") == last))
        if not seen["last"]:
            break
        frontier = new.where(F.col("dist") == last)
    return known.read()


def distances_to(edges: DataFrame, ends: DataFrame, most: int, stride: int = 4) -> DataFrame:
    """(node, dist): least hops from each node to any of `ends` (node), up to `most`; ends themselves are 0."""
    return nearest_ends(edges, ends, most, stride).drop("end")


class _Steps:
    """The edges worth taking, and how a table of partial paths goes over them."""

    def __init__(self, edges: DataFrame, ends: DataFrame, max_hops: int, types: list[str] | None, uniqueness: str, hubs: list[Hubs]) -> None:
        used = edges.where(F.col("type").isin(types)) if types else edges
        flags = [c for c in ("summary", "resolved_virtual") if c in edges.columns]
        used = written(used.where("src is not null and dst is not null").select("src", "dst", F.xxhash64("src", "dst", "type", *flags).alias("edge")).distinct(), "edges")
        self.hubs = [h for h in hubs if not types or h.type in types]
        reach = nearest_ends(used.select("src", "dst"), ends, max_hops, hubs=self.hubs)
        # An edge is worth taking if an end is near enough behind it.
        near = reach.toDF("dst", "dist", "end")
        self.direct = written(used.join(near, "dst"), "edges")
        self.leave = [written(h.leave.join(near, "dst"), "leave") for h in self.hubs]
        self.flags, self.max_hops, self.uniqueness = flags, max_hops, uniqueness

    def ahead(self) -> DataFrame:
        """(last, more, end): how many hops, at least one, it takes from a node to the nearest end, and the least of these ends."""
        found = self.direct.select(F.col("src").alias("last"), "dist", "end")
        for h, leave in zip(self.hubs, self.leave, strict=True):
            best = leave.groupBy("hub").agg(F.min(F.struct("dist", "end")).alias("m"))
            found = found.unionByName(h.enter.join(best, "hub").select(F.col("src").alias("last"), "m.dist", "m.end"))
        best = found.groupBy("last").agg(F.min(F.struct("dist", "end")).alias("m"))
        return best.select("last", (F.col("m.dist") + 1).alias("more"), "m.end")

    def over(self, front: DataFrame, hop: int) -> DataFrame:
        """front (last, path, trail) after one more hop, with the distance that is left: last, path, trail, dist."""
        step = front.join(self.direct, front["last"] == self.direct["src"]).select("path", "trail", "dst", "edge", "dist")
        for h, leave in zip(self.hubs, self.leave, strict=True):
            flag = {"summary": F.lit(h.summary).cast("boolean"), "resolved_virtual": F.lit(h.resolved_virtual).cast("boolean")}
            key = F.xxhash64("last", "dst", F.lit(h.type), *[flag[c] for c in self.flags])
            more = front.join(h.enter.withColumnRenamed("src", "last"), "last").join(leave, "hub").where("last <> dst").select("last", "path", "trail", "dst", "dist")
            more = (more.distinct() if h.several else more).join(h.skip.withColumnRenamed("src", "last"), ["last", "dst"], "left_anti")
            step = step.unionByName(more.select("path", "trail", "dst", key.alias("edge"), "dist"))
        fresh = ~F.array_contains("path", F.col("dst")) if self.uniqueness == "node" else ~F.array_contains("trail", F.col("edge"))
        trail = F.array_append("trail", F.col("edge")) if self.uniqueness == "edge" else F.col("trail")
        return step.where((F.col("dist") <= self.max_hops - hop) & fresh).select(F.col("dst").alias("last"), F.array_append("path", F.col("dst")).alias("path"), trail.alias("trail"), "dist")


def _starts(starts: DataFrame) -> DataFrame:
    return starts.select("node").distinct().select(F.col("node").alias("last"), F.array("node").alias("path"), F.array().cast("array<bigint>").alias("trail"))


def expand(
    edges: DataFrame,
    starts: DataFrame,
    ends: DataFrame,
    max_hops: int = 15,
    types: list[str] | None = None,
    uniqueness: str = "node",
    stop: str = "pair",
    most: int | None = None,
    hubs: list[Hubs] = (),
) -> DataFrame:
    """Paths of 1..max_hops edges from `starts` to `ends` (column node): (path array<node>, path_len).

    uniqueness 'node': no node twice. 'edge': no edge twice, nodes may repeat. stop 'pair': a path ends at its own sink
    but may pass others; 'any': it ends at the first sink met. With 'edge', paths may run on through their sink.
    most: only so many, the first by length, source, sink and path (see first_paths); else all. hubs: edges beside the given ones.
    """
    if uniqueness not in ("node", "edge") or stop not in ("pair", "any"):
        raise ValueError(f"uniqueness {uniqueness!r}, stop {stop!r}")
    steps = _Steps(edges, ends, max_hops, types, uniqueness, list(hubs))
    if most is not None:
        return first_paths(steps, starts, stop, most)
    front, done = _starts(starts), Parts(edges.sparkSession, "paths")
    for hop in range(1, max_hops + 1):
        step = steps.over(front, hop).select("last", "path", "trail", (F.col("dist") == 0).alias("hit"), F.lit(hop).alias("path_len"))
        step, seen = done.add(step, rows=F.count(F.lit(1)))
        if not seen["rows"]:
            break
        front = (step.where("not hit") if stop == "any" else step).drop("hit", "path_len")
    return done.read().where("hit").select("path", "path_len")


#: Partial paths kept for each path asked for, and how much more of them if that was not enough.
KEPT, GROWTH = 4, 8
#: Partial paths that are sent to all executors at most, and calls.
SENT, CALLS = 20_000, 100_000
#: Parts of a hub that calls are dealt to.
SALTS = 16


def first_paths(steps: _Steps, starts: DataFrame, stop: str, most: int, kept: int = KEPT) -> DataFrame:
    """The first `most` paths by (path_len, first node, last node, path), best-first.

    A partial path of h hops cannot become anything before (h + the distance to the nearest end, its first node, the least end so near, itself).
    By this bound the first most x kept partial paths of a hop go on, and the bound of the next one is remembered. As long as
    walks to the nearest end meet no node of the path, `most` of them are enough; where they do, more may be needed. So when
    the last path looked for is known it is compared with what was left behind; if anything of that could come before, the search is done
    again with more room, in the end with room for all. A hop holds most x kept rows and an answer most x hops.
    """
    spark = steps.direct.sparkSession
    ahead = written(steps.ahead(), "ahead")
    as_bytes = lambda x: x.encode() if isinstance(x, str) else x
    while True:
        room, hits = most * kept, Parts(spark, "hits")
        send = F.broadcast if room <= SENT else lambda df: df
        fronts, left, found = Parts(spark, "fronts"), [], 0
        front = _starts(starts).join(ahead, "last").where(F.col("more") <= steps.max_hops)
        order = ["more", F.col("path")[0], "end", "path", "trail"]
        ranked = lambda rows, n: rows.orderBy(*order).limit(n + 1).withColumn("rank", F.monotonically_increasing_id())
        for hop in range(1, steps.max_hops + 1):
            front, seen = fronts.add(ranked(front.select("last", "path", "trail", "more", "end"), room), rows=F.count(F.lit(1)))
            if not seen["rows"]:
                break
            if seen["rows"] > room:
                r = front.where(F.col("rank") >= room).orderBy("rank").first()
                left.append((hop - 1 + r.more, as_bytes(r.path[0]), as_bytes(r.end), [as_bytes(n) for n in r.path]))
                front = front.where(F.col("rank") < room)
            # What a step reaches is, at an end, a path, and where an end is near enough ahead a partial path; of both the first are kept.
            step = steps.over(send(front), hop).join(ahead.toDF("last", "more", "ahead"), "last", "left")
            go_on = (F.col("more") <= steps.max_hops - hop) & ((F.col("dist") > 0) if stop == "any" else F.lit(True))
            hit = F.when(F.col("dist") == 0, F.struct(F.lit(True).alias("hit"), F.lit(0).alias("more"), F.col("last").alias("end")))
            on = F.when(go_on, F.struct(F.lit(False).alias("hit"), F.col("more").alias("more"), F.col("ahead").alias("end")))
            both = step.select("last", "path", "trail", F.explode(F.array_compact(F.array(hit, on))).alias("k")).select("last", "path", "trail", "k.*")
            place = F.row_number().over(Window.partitionBy("hit").orderBy(*order))
            both = both.withColumn("place", place).where(F.col("place") <= max(room + 1, most)).where(~F.col("hit") | (F.col("place") <= most))
            both, seen = hits.add(both.select("last", "path", "trail", "hit", "more", "end", F.lit(hop).alias("path_len")), hits=F.count_if("hit"))
            front = both.where("not hit")
            found += seen["hits"]
            if found >= most:
                break
        if not hits.paths:
            return spark.createDataFrame([], f"path array<{ahead.schema['end'].dataType.simpleString()}>, path_len int")
        first = hits.read().where("hit").orderBy("path_len", F.col("path")[0], "end", "path").limit(most)
        if left:
            last = first.orderBy(F.desc("path_len"), F.desc(F.col("path")[0]), F.desc("end"), F.desc("path")).first() if found >= most else None
            before = lambda b: (last.path_len, as_bytes(last.path[0]), as_bytes(last.end), [as_bytes(n) for n in last.path[: len(b[3])]]) < b
            if last is None or not all(before(b) for b in left):
                kept *= GROWTH
                continue
        return first.select("path", "path_len")


def project(paths: DataFrame, nodes: DataFrame, key: str | None = None) -> DataFrame:
    """Path records: ends, their files, functions and lines, and path_nodes in order; unknown values are '' and 0, of a node that
    is missing all of them."""
    one = F.struct(
        F.col("node_id"), F.coalesce("file_path", F.lit("")).alias("file_path"), F.coalesce("function_name", F.lit("")).alias("function_name"),
        F.coalesce("line_start", F.lit(0)).alias("line_number"),
    )
    numbered = paths.withColumn("pid", F.xxhash64("path"))
    at = numbered.select("pid", "path", "path_len", F.posexplode("path").alias("pos", "node_id"))
    known = nodes.select("node_id", one.alias("one"))
    unknown = F.struct(F.col("node_id"), F.lit("").alias("file_path"), F.lit("").alias("function_name"), F.lit(0).alias("line_number"))
    joined = at.join(known, "node_id", "left").withColumn("one", F.coalesce("one", unknown))
    full = joined.groupBy("pid", "path", "path_len").agg(F.sort_array(F.collect_list(F.struct("pos", "one"))).alias("seq"))
    full = full.select("path", "path_len", F.transform("seq", lambda s: s["one"]).alias("path_nodes"))
    return with_ends(full)


def with_ends(records: DataFrame) -> DataFrame:
    """records (path_nodes, path_len, ...) with src_*, snk_*, intermediate_nodes and crosses_files."""
    first, last = F.col("path_nodes")[0], F.element_at("path_nodes", -1)
    inner = F.slice("path_nodes", 2, F.greatest(F.size("path_nodes") - 2, F.lit(0)))
    parts = [("id", "node_id"), ("file", "file_path"), ("func", "function_name"), ("line", "line_number")]
    return records.select(
        "*", *[first[f].alias(f"src_{n}") for n, f in parts], *[last[f].alias(f"snk_{n}") for n, f in parts],
        inner.alias("intermediate_nodes"), (first["file_path"] != last["file_path"]).alias("crosses_files"),
    )


def shortest(paths: DataFrame, most: int = 100, ties: list[str | Column] = ("src_id", "snk_id", "path")) -> DataFrame:
    """The first paths by length, then by a total order over the rest."""
    return paths.orderBy("path_len", *ties).limit(most)


def with_flags(edges: DataFrame) -> DataFrame:
    """edges with the two flags, null where they are missing."""
    missing = [c for c in ("summary", "resolved_virtual") if c not in edges.columns]
    return edges.withColumns({c: F.lit(None).cast("boolean") for c in missing}) if missing else edges


def opaque_hubs(nodes: DataFrame, edges: DataFrame, calls: list[str] = catalog.OPAQUE_COPIES) -> Hubs:
    """A REACHING_DEF edge (summary) around each opaque copy call, from all that flows in to all that flows out, where no summary edge exists yet."""
    hub = nodes.where(F.contains("node_type", F.lit("CALL")) & F.col("function_name").isin(calls)).select(F.col("node_id").alias("hub"))
    flow = edges.where(F.col("type").isin("REACHING_DEF", "CALL"))
    into = flow.join(hub, flow["dst"] == hub["hub"]).select("src", "hub").distinct()
    out = flow.join(hub, flow["src"] == hub["hub"]).select("hub", "dst").distinct()
    had = with_flags(edges).where("summary").select("src", "dst").distinct()
    return Hubs(into, out, had, "REACHING_DEF", summary=True, several=True)


def bridge_opaque_calls(nodes: DataFrame, edges: DataFrame, calls: list[str] = catalog.OPAQUE_COPIES, most: int | None = 500) -> DataFrame:
    """edges and those of opaque_hubs, one by one; the first `most` by ends (None: all).

    Each source that has an edge at all has at least one, so the first `most` sources with one are enough: sources are taken in
    their order, twice as many each time that they did not give enough, and of each the first `most`.
    """
    hubs = opaque_hubs(nodes, edges, calls)
    if most is None:
        new = hubs.pairs()
    else:
        enter, tried = written(hubs.enter.join(hubs.leave.select("hub").distinct(), "hub", "left_semi"), "enter"), 2 * most
        sources = enter.select("src").distinct().orderBy("src")
        while True:
            some = written(sources.limit(tried), "sources")
            few = Hubs(enter.join(F.broadcast(some) if tried <= SENT else some, "src", "left_semi"), hubs.leave, hubs.skip, several=True)
            each = few.pairs().withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("k") <= most)
            new = written(each.orderBy("src", "dst").limit(most).select("src", "dst"), "bridges")
            if new.count() >= most or some.count() < tried:
                break
            tried *= 4
    more = new.select("src", "dst", F.lit("REACHING_DEF").alias("type"), F.lit(True).alias("summary"), F.lit(None).cast("boolean").alias("resolved_virtual"))
    return edges.unionByName(more, allowMissingColumns=True)


def virtual_hubs(nodes: DataFrame, edges: DataFrame, within: str | None = None) -> Hubs:
    """CALL edges (resolved_virtual) from each call of a function to all other functions of its name, the name being the hub; within: a
    column of nodes whose value, too, must be the same."""
    place = F.col(within) if within else F.lit("")
    calls = nodes.where(F.contains("node_type", F.lit("CALL"))).select(F.col("node_id").alias("src"))
    functions = nodes.where("node_type = 'AST_FUNC'").select(F.struct(place.alias("place"), F.col("function_name").alias("name")).alias("hub"), F.col("node_id").alias("dst"))
    functions = functions.where("hub.name is not null and hub.place is not null")
    if calls.limit(CALLS + 1).count() <= CALLS:  # else edges are shuffled once more
        calls = F.broadcast(calls)
    # Rows of a hub are dealt together, in SALTS parts: what is shuffled here and to the leaving edges then repeats, and is small. Copies of an edge change
    # neither the least nor the greatest dst.
    known = edges.where("type = 'CALL'").join(calls, "src", "left_semi").select("src", "dst").join(functions, "dst")
    known = known.withColumn("salt", F.pmod(F.xxhash64("src"), F.lit(SALTS))).repartition("hub", "salt")
    enter = known.groupBy("hub", "salt", "src").agg(F.min("dst").alias("dst"), F.max("dst").alias("last"))
    # A function that is the only one of its name which a call has directly gets no second edge; of several each is another's namesake.
    own = enter.where("dst = last").select("src", "dst")
    had = with_flags(edges).where("resolved_virtual").select("src", "dst")
    enter = enter.select("src", "hub", F.when(F.col("dst") == F.col("last"), F.col("dst")).alias("own"))
    return Hubs(enter, functions, own.union(had).distinct(), "CALL", resolved_virtual=True, rest=had)


def resolve_virtual_calls(nodes: DataFrame, edges: DataFrame, within: str | None = None) -> DataFrame:
    """edges and those of virtual_hubs, one by one."""
    more = virtual_hubs(nodes, edges, within).pairs().withColumns({"type": F.lit("CALL"), "summary": F.lit(None).cast("boolean"), "resolved_virtual": F.lit(True)})
    return edges.unionByName(more, allowMissingColumns=True)


def find_paths(
    nodes: DataFrame, edges: DataFrame, sources: DataFrame, sinks: DataFrame, changed: DataFrame | None = None,
    max_hops: int = 15, uniqueness: str = "node", stop: str = "pair", most: int | None = 100, extend: bool = True,
    most_bridges: int | None = 500, within: str | None = None,
) -> DataFrame:
    """The whole search: edge synthesis (opaque copies, then virtual calls), expansion, projection, order and cut.

    most_bridges: opaque copies get so many edges (None: all, by hubs). within: calls resolve to functions of the same value of this column of nodes.
    """
    hubs = []
    if extend:
        edges = with_flags(edges)
        if most_bridges is None:
            hubs.append(opaque_hubs(nodes, edges))
        else:
            edges = bridge_opaque_calls(nodes, edges, most=most_bridges)
        hubs.append(virtual_hubs(nodes, edges, within))
        hubs = [replace(h, enter=written(h.enter, "enter")) for h in hubs]
        hubs = [replace(h, leave=written(h.leave, "leave"), skip=written(h.skip, "skip")) for h in hubs if not h.enter.isEmpty()]
    types = catalog.FLOW_EDGES if uniqueness == "node" else catalog.TRAIL_EDGES
    starts = unsent(source_nodes(nodes, sources, changed).select(F.col("node_id").alias("node")))
    ends = unsent(sink_nodes(nodes, sinks).select(F.col("node_id").alias("node")))
    records = project(expand(edges, starts, ends, max_hops, types, uniqueness, stop, most, hubs), nodes)
    return records if most is None else shortest(records, most)


def chain_paths(events: DataFrame, key: list[str], order: list[str], source: Column, sink: Column, max_hops: int = 15) -> DataFrame:
    """Paths where each key's rows form one chain: positions instead of hops, as (key.., src_pos, snk_pos, path_len).

    One window over the key and one join; sources are dealt to the blocks of positions that they can reach, so a long
    chain joins block by block.
    """
    at = events.select("*", F.row_number().over(Window.partitionBy(*key).orderBy(*order)).alias("pos"))
    block = lambda c: F.floor(c / max_hops)
    starts = at.where(source).select(*key, F.col("pos").alias("src_pos"), F.explode(F.array_distinct(F.array(block(F.col("pos") + 1), block(F.col("pos") + max_hops)))).alias("blk"))
    stops = at.where(sink).select(*key, F.col("pos").alias("snk_pos"), block(F.col("pos")).alias("blk"))
    met = starts.join(stops, [*key, "blk"]).where(F.col("snk_pos").between(F.col("src_pos") + 1, F.col("src_pos") + max_hops))
    return met.select(*key, "src_pos", "snk_pos", (F.col("snk_pos") - F.col("src_pos")).cast("int").alias("path_len"))
