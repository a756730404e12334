"""Connected components by hub contraction, on tables of edges that never meet on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, table


def _mark(edges: DataFrame) -> tuple:
    """Row count and order-free checksum of an edge table."""
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the smallest node reachable, itself included.

    Alternates two steps until nothing changes. Large-star links every larger
    neighbour of a node to its least neighbour; small-star links the smaller
    ones, and the node, to it. Both need each node's minimum only (a partial
    aggregate), so that a hub of any degree costs no more than its edges, and
    rounds grow with the logarithm of the longest path. Each round is written
    to the shared folder. Nodes must not be null; loops and repeats are fine.
    """
    e = table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = table(large)
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(low, large.a == low.u).select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = table(small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        after = _mark(new)
        drop_table(large)
        drop_table(e)
        e, same = new, after == mark
        mark = after
        if same:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
