"""Connected components of link tables, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) of every node with a link to another. No neighbour list is ever
    gathered: a round takes minima and joins, which Spark pre-aggregates and may split."""
    pairs = stage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")
    for _ in range(most_rounds):
        # Done when all are stars: no node points to one that points on, and none points to two.
        on = pairs.join(pairs.select(F.col("u").alias("v")), "v", "left_semi")
        if on.isEmpty() and pairs.groupBy("u").count().filter("count > 1").isEmpty():
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        # Large star: every larger neighbour of x points to x's least neighbour.
        large = pairs.join(least, F.col("v") == F.col("x")).select("u", F.col("m").alias("v")).distinct()
        # Small star: every smaller neighbour of u, and u, point to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        pairs = stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
