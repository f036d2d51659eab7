"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that an edge names; component is its least node.

    Large-star and small-star steps in turn (each hangs a node's neighbours on the least node it
    sees) end in stars around the least nodes, in rounds that grow with the logarithm of the
    components' size. A step is two aggregations and a join on the node; nothing is collected but
    one checksum a round. The edges of a round are checkpointed in the shared folder, so the plan
    does not grow and a lost executor costs a round at most.

    Nulls: edges with a null end are dropped. Loops keep their node. Repeated edges and either
    direction are one edge. No edges: no rows. Ties cannot occur, nodes are compared by value.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    nodes = both.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = cut(_down(both).filter("u <> v").distinct())
    seen = None
    for _ in range(most_rounds):
        now = cut(_small_star(_large_star(now)))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    hung = now.groupBy("u").agg(F.min("v").alias("least"))
    return nodes.join(hung, nodes.node == hung.u, "left").select("node", F.coalesce("least", "node").alias("component"))


def _down(e: DataFrame) -> DataFrame:
    return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _large_star(e: DataFrame) -> DataFrame:
    """Neighbours above a node hang on the least of the node and its neighbours."""
    near = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
    up = near.filter("v > u")
    return up.join(least, up.u == least.k).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its neighbours below it hang on the least of these."""
    down = _down(e)
    least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    below = down.join(least, down.u == least.k)
    moved = below.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
