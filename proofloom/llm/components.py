"""Connected components of a distributed edge table.

Alternating large-star and small-star steps: every step aggregates an edge table
that never grows beyond its first size by node and joins the result to it, each
result is written to the shared folder, and the driver sees only counts. A node
with a large share of all links is aggregated before the shuffle, and its
partition of the join is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: (u, v), u > v. Each node's neighbours on one side are linked to the node's least neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    # written, so that the join can split the partition of a node with very many neighbours
    least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    joined = both.join(least, "u")
    moved = joined.filter("v > u") if large else joined
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _stars(e: DataFrame) -> bool:
    """Whether each node is either a root or linked to one node only: nothing moves any more."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("leaf"), F.lit(0).alias("root")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root")).filter("leaf + root > 1 and leaf > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u long, v long); root is the component's least node.

    Self-links, repeated and reversed links are allowed. Nulls are not. No
    links: an empty table. The number of rounds grows with the logarithm of the
    longest chain; each ends in a written table.
    """
    e = saved(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while not _stars(e):
        f = saved(_star(_star(e, large=True), large=False), "edges")
        drop(e)
        e = f
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
