"""Connected components of an edge table, by alternating star contractions until nothing changes."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that spark.checkpoint.dir names (a temporary one stands in for it in local mode alone)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="components-"))
    return df.checkpoint()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour (itself included)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    return both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    joined = down.join(low, "a")
    return joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b"))).where("a != b").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    Self-loops, repeated and reversed edges and null ends are allowed (a null end makes no edge). Each round is
    checkpointed; the number of rounds grows with the logarithm of the graph's diameter. Skew: a hub's edges meet
    only through a minimum that is taken before the shuffle, and Spark splits the join that follows."""
    now = checkpointed(edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where(F.col(src).isNotNull() & F.col(dst).isNotNull()).distinct())
    nodes = now
    now = now.where("a != b")
    mark = None
    while True:
        now = checkpointed(_small_star(_large_star(now)))
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    alone = nodes.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return stars.union(roots).union(alone).groupBy("node").agg(F.min("component").alias("component"))
