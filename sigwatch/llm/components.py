"""Connected components of an edge table by alternating star operations.

Large-star links each node's greater neighbours to the smallest node it sees, small-star its
smaller ones; both keep connectivity and shrink depth, so rounds grow with the logarithm of the
longest path. Every round is written to the shared folder. Minima combine before the shuffle,
and the join back splits hubs as skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sigwatch.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    if large:
        found = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        found = (both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))))
    return found.where("a <> b").distinct()


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """``edges`` has columns a and b. Rows (a, b): b is the smallest node of a's component.

    Smallest nodes themselves, and nodes without an edge, have no row.
    """
    edges, before = stored(edges.where("a <> b").distinct(), "edges"), None
    while True:
        edges = stored(_star(stored(_star(edges, True), "stars"), False), "edges")
        state = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")),
                                F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return edges
        before = state
