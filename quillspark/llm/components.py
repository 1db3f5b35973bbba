"""Connected components of edge lists, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) of every node of edges (a, b); loops and repeated edges do no harm.

    A round is two aggregations of a minimum and two joins, so a node with very many edges is summed before the shuffle;
    the number of rounds grows with the logarithm of the longest chain. Each round's edges are a table in the shared folder.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    known = digest(now)
    while known[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        after = stored(small, "edges")
        dropped(now)
        now, before, known = after, known, digest(after)
        if known == before:
            break
    # every edge now goes to the least node of its component
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def digest(edges: DataFrame) -> tuple:
    """Count and hash sums of distinct edges: equal edge sets have equal ones, and a round that changes an edge changes them."""
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("y")).first()
    return (r["n"], r["x"], r["y"])
