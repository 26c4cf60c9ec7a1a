"""Connected components of an edge table, with every step a distributed join or grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``u, root`` for every node of ``edges (u long, v long)``: the least node it reaches.

    Alternating large-star and small-star rounds; rounds grow with the logarithm of the longest
    path.  Each round is a table in the shared folder, so a lost executor costs no earlier round.
    """
    edges = materialise(_small_star(edges), "star")
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        edges = materialise(_small_star(_large_star(edges)), "star")
    members = edges.select("u", F.col("v").alias("root"))
    return members.unionByName(edges.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
