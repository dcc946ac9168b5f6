"""Connected components by alternating large-star and small-star rounds.

Each round is two grouped minima and two joins on edge rows; nothing is gathered on the
driver but two checksums a round. The minima, a row a node, are stored before they meet the
edges again, so both sides of that join are plain exchanges and a hub's edges, its streamed
side, are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpoint


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v in; the same after one large-star or small-star step."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = checkpoint(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        out = near.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = checkpoint(edges.groupBy("u").agg(F.min("v").alias("m")))
        out = edges.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", F.col("e.m").alias("v"))
    return out.where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge: component is the smallest node reachable.

    edges has two bigint columns, a and b, in any order; repeats, loops and nulls are ignored.
    No edges give no rows. Rounds, of the order of the squared logarithm of the nodes, go on
    until one changes nothing.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = checkpoint(e)
    mark = _mark(e)
    while mark[0]:
        e = checkpoint(_star(checkpoint(_star(e, True)), False))
        was, mark = mark, _mark(e)
        if was == mark:
            break
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
