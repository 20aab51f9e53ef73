"""Connected components by alternating large and small stars, all in joins and groupings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.llm.common import written


#: Edges a task holds; small graphs go through few tasks and files a round.
EDGES = 200_000


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(a, b) of any orderable type -> (node, root): the smallest node reachable. Nodes without edges don't appear.

    A round hangs each node's larger neighbours on its least neighbour, then its smaller ones; every round is written,
    and it ends when the edges are stars around their least nodes. The number of rounds grows with the logarithm of
    the longest path.
    """
    kind = edges.schema[0].dataType
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    parts = max(1, math.ceil(now.count() / EDGES))  # a round has no more edges than the one before
    saved = lambda df: written(df.coalesce(parts), compression="uncompressed")
    for _ in range(rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        large = saved(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        after = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        # stars: no node has two parents, and no parent has a parent
        twice = after.groupBy("u").count().where("count > 1").select("u")
        if after.join(after.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and twice.isEmpty():
            now = after
            break
        now = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").cast(kind).alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").cast(kind).alias("node"), F.col("v").cast(kind).alias("root")).unionByName(roots)
