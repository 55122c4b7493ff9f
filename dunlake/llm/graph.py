"""Connected components by alternating large and small stars, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlake.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the smallest one of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Join a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    # both from one pass over the join; repeated rows go in the tasks themselves, before they are shuffled
    moved = edges.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return moved.select("e.*").where("a != b")


def _nodes(edges: DataFrame) -> DataFrame:
    """Each node with its smallest neighbour below it or itself, and whether it keeps the edges from being stars: more than
    one neighbour below it, or neighbours on both sides."""
    ends = edges.select(F.col("a").alias("id"), "b", F.lit(False).alias("above")).unionByName(edges.select(F.col("b").alias("id"), F.lit(None).cast("long").alias("b"), F.lit(True).alias("above")))
    least, most = F.min("b"), F.max("b")
    uneven = least.isNotNull() & ((least != most) | F.max("above"))
    return ends.groupBy("id").agg(F.coalesce(least, F.col("id")).alias("component_id"), uneven.alias("uneven"))


def components(edges: DataFrame) -> DataFrame:
    """Smallest id of each node's component: (id, component_id), for the nodes of ``edges`` (a, b).

    Loops, repeated edges and edges with a null don't matter; no edges give no rows. Each round is written to the shared
    folder, and so are its nodes. Rounds end when the edges are stars around the smallest ids, after about the logarithm
    of the longest path. Minima are pre-aggregated and the joins are plain, so a hub is split by skew handling.
    """
    now = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stored(now, "edges")
    while True:
        now = stored(_small_star(_large_star(now).distinct()).distinct(), "edges")
        nodes = stored(_nodes(now), "nodes")
        if not nodes.where("uneven").head(1):
            return nodes.select("id", "component_id")
