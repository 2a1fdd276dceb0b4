"""Connected components by alternating large and small stars, as joins of bounded rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
    least = both.groupBy("high").agg(F.min("low").alias("least")).withColumn("least", F.least("high", "least"))
    return both.join(least, "high").filter(F.col("low") > F.col("high")).select(
        F.col("low").alias("high"), F.col("least").alias("low")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("high").agg(F.min("low").alias("least"))
    moved = edges.join(least, "high").filter("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.unionByName(least.select("high", F.col("least").alias("low"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of every id in ``links`` (``a, b``): the smallest id that it reaches.

    Ids of no link and links of an id to itself give no row. Every round is written to
    the shared folder; rounds go on until the edges stay the same, a logarithmic number
    of them. A hub of many links is one key of a join, which adaptive execution splits;
    its smallest neighbour is combined before the shuffle.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()
    mark = None
    while True:
        edges = stage(_small_star(_large_star(edges).distinct()) if mark is not None else edges)
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)")), F.max("high")
        ).first()
        if now == mark:
            break
        mark = now
    leaves = edges.select(F.col("high").alias("id"), F.col("low").alias("component"))
    roots = edges.select(F.col("low").alias("id"), F.col("low").alias("component")).distinct()
    return leaves.unionByName(roots)
