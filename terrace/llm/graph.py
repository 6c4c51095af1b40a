"""Connected components of links between documents, as DataFrame joins with tables in the shared folder between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star operation: links each node's neighbours (the larger ones, or the smaller ones and itself) to the least of them."""
    if small:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = near.join(least, "u")
    out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).where(F.lit(True) if small else F.col("v") > F.col("u"))
    if small:
        out = out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one link, to a node that has none: then that one is the least of the component."""
    roles = edges.select(F.col("a").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(edges.select(F.col("b").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    each = roles.groupBy("n").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return each.where((F.col("out") > 1) | (F.col("out") > 0) & (F.col("in") > 0)).isEmpty()


def components(edges: DataFrame, path: str, most: int = 60) -> DataFrame:
    """node, component (the least node it is connected with) of every node that has an edge. edges: a, b.

    Alternates large stars and small stars until all links are stars; each round is written below `path`. Nothing but
    whether that is so reaches the driver.
    """
    now = stored(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a != b").select("a", "b").distinct(), f"{path}/0")
    for i in range(1, most + 1):
        if _settled(now):
            break
        now = stored(_star(_star(now, small=False), small=True), f"{path}/{i}")
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
