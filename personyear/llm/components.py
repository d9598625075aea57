"""Connected components of an edge list, by the published large-star / small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from personyear.session import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(edges: DataFrame) -> DataFrame:
    """Per node the smallest of itself and its neighbours; combined on the map side."""
    return edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    sides = _both_ways(edges)
    joined = sides.join(_least(sides), "a")
    return joined.where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("m").alias("a"), "b")
    kept = least.select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(kept).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable, for every node that has an edge.

    ``edges`` has the long columns ``a`` and ``b``.  Rounds end when they change
    nothing; each one is written, so lineage stays short and a lost executor
    costs one round.  A node with very many edges is never gathered: minima are
    combined before the shuffle and the join on it can be split.
    """
    now = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while True:
        # The first of the two need not be written: the second reads it a few times only.
        now = written(_small_star(written(_large_star(now), "large-star")), "small-star")
        after = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == state:
            break
        state = after
    nodes = now.groupBy("b").agg(F.min("a").alias("component")).withColumnRenamed("b", "node")
    roots = now.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    return nodes.union(roots)
