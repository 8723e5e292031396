"""Connected components of links between integer ids, by alternating large and small stars (Kiveris et al., 2014).

Every round is a sum by node, pre-aggregated, and a join whose skewed partitions are split at run time, so that a hub is no
bottleneck; edges only, never a group's members, meet in a task. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import delete, release, written


def star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v. Large: each node's larger neighbours go to its smallest one; small: its smaller ones, and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.distinct()


def components(links: DataFrame, folder: str) -> DataFrame:
    """links: a and b, longs. Gives id and component (the smallest id reachable) for each id that is not its component's smallest."""
    spark = links.sparkSession
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, k, before = written(edges, f"{folder}/0"), 0, None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(2**31 - 1)))).first()
        if before == now or not now[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before, k = now, k + 1
        large = written(star(edges, True), f"{folder}/{k}-large")
        small = written(star(large, False), f"{folder}/{k}")
        delete(spark, f"{folder}/{k}-large")
        delete(spark, f"{folder}/{k - 1}")
        edges = small
        release(spark)
