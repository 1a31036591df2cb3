"""Connected components over an edge table (alternating large-star and small-star, Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kindred.plans.scratch import Scratch


def _least_neighbour(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(u, m): each node's least neighbour or itself. Written as a table, so that the join back shuffles both sides and adaptive execution may split a hub."""
    return scratch.cut(edges.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m")))


def _step(scratch: Scratch, edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (u > v). Large: both directions, reattach greater neighbours; small: reattach lesser ones and the node."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least_neighbour(scratch, both)
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = _least_neighbour(scratch, edges)
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = scratch.cut(moved.where("u > v").distinct())
    scratch.drop(least)
    return out


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for every node of an undirected edge table of longs; component is the least node reachable.

    Self-loops and edges with a null end are left out: a node that has no other edge gets no row.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    now = scratch.cut(
        edges.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).cast("long").alias("u"), F.least(src, dst).cast("long").alias("v")).distinct()
    )
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.min(F.col("v"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        wide = _step(scratch, now, large=True)
        scratch.drop(now)
        now = _step(scratch, wide, large=False)
        scratch.drop(wide)
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
