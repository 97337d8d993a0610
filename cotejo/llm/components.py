"""Connected components of an edge table by alternating large-star and small-star steps, without driver-side links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm.common import release, stage_table


def _with_least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges (u, v) with m = min(u, all v of u), and the table behind m. That table is stored, so the join has two plain
    exchanges and the rows of a hub can be split over tasks at run time."""
    least = stage_table(edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    return edges.join(least, "u"), least


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    starred, least = _with_least(both)
    return starred.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred, least = _with_least(down)
    pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
    return starred.select(F.explode(pairs).alias("e")).select("e.u", "e.v"), least


def components(edges: DataFrame) -> DataFrame:
    """(u, v) of long nodes to (node, label): each node that has an edge, and the least node of its component.

    Each step writes its edges to the shared folder; the number of steps grows at most as the square of the logarithm of the
    node count, and is 1 or 2 for stars. It ends when every node has one parent and no parent has another.
    """
    now = stage_table(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    while True:
        large, first = _large_star(now)
        large = stage_table(large.distinct(), "large-star")
        small, second = _small_star(large)
        before, now = now, stage_table(small.filter("u <> v").distinct(), "edges")
        release(before, large, first, second)
        ends = now.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(now.select(F.col("v").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        mixed = ends.groupBy("n").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).filter("c > 1 OR (c > 0 AND p > 0)")
        if not mixed.limit(1).count():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
