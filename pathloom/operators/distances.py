"""Least distances to a set of ends, kept up to date while a graph changes.

A table (node, dist) as paths.distances_to gives it is brought from one graph to the next by what changed, in two passes, each by layers.
First what is lost: a node of distance d stays as long as an edge that is left leads to a node of distance d - 1 that stays; looked at are only nodes that lost such
an edge, or the end they were, layer after layer. Then what is gained: lost nodes are offered their best neighbours among those that stayed, sources of new edges
and new ends theirs, and offers spread backwards from the nearest on, as long as they are better than what is known. So the rows written are those of
the nodes that change, and of the offers made to them, whatever the graph's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.tables import Parts, discard, written

def lost_nodes(known: DataFrame, edges: DataFrame, cut: DataFrame, ends: DataFrame, most: int) -> DataFrame:
    """(node, dist): nodes of known whose distance no longer holds. edges: those left (src, dst); cut: those gone; ends: those left (node)."""
    spark = known.sparkSession
    at = lambda end: known.toDF(end, f"{end}_dist")
    # Who may be lost: ends that are none any more, and sources of edges that were a shortest way.
    no_end = known.where("dist = 0").join(ends, "node", "left_anti")
    left = cut.join(at("src"), "src").join(at("dst"), "dst").where("src_dist = dst_dist + 1").select(F.col("src").alias("node"), F.col("src_dist").alias("dist"))
    seeds = written(no_end.unionByName(left).distinct(), "seeds")
    layers = {r.dist for r in seeds.select("dist").distinct().collect()}
    lost, last = Parts(spark, "lost"), None
    lost.add(seeds.limit(0))
    for dist in range(most + 1):
        if dist not in layers and last is None:
            continue
        asked = seeds.where(F.col("dist") == dist)
        if last is not None:
            behind = edges.join(last.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"))
            asked = asked.unionByName(behind.distinct().join(known.where(F.col("dist") == dist), "node")).distinct()
        if dist:
            # A way that is left: to a node one nearer that is not lost.
            near = edges.join(asked.select(F.col("node").alias("src")), "src", "left_semi").join(known.where(F.col("dist") == dist - 1).select(F.col("node").alias("dst")), "dst", "left_semi")
            if last is not None:
                near = near.join(last.select(F.col("node").alias("dst")), "dst", "left_anti")
            asked = asked.join(near.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
        part, seen = lost.add(asked, n=F.count(F.lit(1)))
        last = part if seen["n"] else None
    return lost.read()


def updated(known: DataFrame, edges: DataFrame, ends: DataFrame, most: int, cut: DataFrame | None = None, new: DataFrame | None = None, new_ends: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(the table for the graph as it is now, what changed: node, dist, null where there is none any more).

    known: the table before (node, dist), up to `most`. edges, ends: all there are now (src, dst; node). cut: edges that are gone and in edges no more;
    new: edges, and new_ends: ends, that were not there before. Parallel edges are one. ends that are gone need not be told.
    """
    spark = known.sparkSession
    pair = lambda df: edges.select("src", "dst").limit(0) if df is None else df.select("src", "dst").distinct()
    edges, cut, new = edges.select("src", "dst"), pair(cut), pair(new)
    gone = written(lost_nodes(known, edges, cut.join(edges, ["src", "dst"], "left_anti"), ends, most), "gone")
    stay = known.join(gone.select("node"), "node", "left_anti")
    far = stay.toDF("dst", "dist")
    # Offers: to what was lost, from what stays; to sources of new edges; to new ends.
    offers = edges.join(gone.select(F.col("node").alias("src")), "src", "left_semi").unionByName(new).join(far, "dst").select(F.col("src").alias("node"), (F.col("dist") + 1).alias("dist"))
    if new_ends is not None:
        offers = offers.unionByName(new_ends.select("node", F.lit(0).alias("dist")))
    offers = written(offers.where(F.col("dist") <= most).groupBy("node").agg(F.min("dist").alias("dist")), "offers")
    layers = {r.dist for r in offers.select("dist").distinct().collect()}
    taken, last = Parts(spark, "taken"), None
    taken.add(offers.limit(0))
    for dist in range(most + 1):
        if dist not in layers and last is None:
            continue
        layer = offers.where(F.col("dist") == dist).select("node")
        if last is not None:
            layer = layer.unionByName(edges.join(last.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")))
        better = layer.distinct().join(stay, "node", "left").where(F.col("dist").isNull() | (F.col("dist") > dist)).select("node")
        part, seen = taken.add(better.join(taken.read().select("node"), "node", "left_anti").withColumn("dist", F.lit(dist)), n=F.count(F.lit(1)))
        last = part if seen["n"] else None
    now = taken.read()
    changed = gone.select("node").join(now, "node", "left_anti").select("node", F.lit(None).cast("int").alias("dist")).unionByName(now)
    changed = changed.join(known.toDF("node", "was"), "node", "left").where(~F.col("dist").eqNullSafe(F.col("was"))).select("node", "dist")
    out = written(stay.join(now.select("node"), "node", "left_anti").unionByName(now), "distances")
    changed = written(changed, "changed")
    discard(gone, offers)
    return out, changed
