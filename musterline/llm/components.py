"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from musterline.llm.tables import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the least node around it: the larger ones, or the smaller ones and itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = both.join(least, "u")
    if large:
        linked = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        linked = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return linked.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node of its component.

    Edges are stored from the larger to the smaller node. Both steps only re-link nodes that
    are connected, and the rounds grow with the logarithm of the longest path.
    """
    now = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    before = None
    while True:
        after = written(_stars(_stars(now, True), False), "edges")
        mark = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        now, before = after, mark
    return after.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
