"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, store_observed


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: long columns a, b. Gives (node, component) of every node that is not the smallest of its component.

    Each step writes its edges to the shared folder, so lineage stays short and a lost executor costs one step. The
    steps needed grow with the logarithm of the longest chain. A node with many edges meets joins that may be split
    and sums that are combined before the shuffle, never one task as a group. Null ends are ignored.
    """
    now, state = _stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while state["n"]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = now, state
        now, state = _stored(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
        discard(before[0])
        if state == before[1]:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _stored(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges, written, and what tells two edge tables apart."""
    return store_observed(edges, "edges", n=F.count(F.lit(1)), mixed=F.bit_xor(F.xxhash64("u", "v")), total=F.sum((F.col("v") % 1_000_003).cast("decimal(30,0)")))
