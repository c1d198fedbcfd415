"""Connected components of large link tables, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import saved


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the least of u and all its v. The minimum is taken in the tasks first, so a hub costs one row a task; the join may be split where u is hot."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return pairs.join(least, "u")


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other, which hangs on none: then the edges are the components."""
    hung = edges.groupBy("u").agg(F.count("*").alias("n"))
    return hung.join(edges.select(F.col("v").alias("u")).distinct().withColumn("centre", F.lit(True)), "u", "left").filter("n > 1 or centre").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each linked node with the smallest node that it reaches. Nulls and self-links are left out; links may repeat.

    Every round is a written table, so the plan stays short and a lost executor costs one round.
    """
    held = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null and x <> y")
    edges = saved(held.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _least(large)
        hung = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = saved(hung.filter("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
