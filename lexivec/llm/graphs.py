"""Connected components of edge tables by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import join_counted
from lexivec.sources.folders import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the edges (a, b) with the smallest node of its component.

    Each round hangs the larger neighbours of a node, and then a node and its smaller neighbours, below the smallest
    one (large star, small star); rounds grow with the logarithm of the longest path. Nodes with very many neighbours
    are looked up by broadcast (at most 1000 at once), so that no task gets all edges of one. Nulls and loops are ignored."""
    at = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a") != F.col("b")).alias("ok")).where("ok").drop("ok").distinct())
    before = None
    while True:
        now = at.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = join_counted(both, least, "a", "n", 2 * now[0]).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_counted(large, least, "a", "n", now[0])
        at = materialize(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(small.select("a", F.col("m").alias("b"))).distinct())
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
