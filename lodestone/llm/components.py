"""Connected components of a table of links by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize


def _star(links: DataFrame, small: bool) -> DataFrame:
    """Links (u > v).  Large star: the larger neighbours of a node go to its smallest neighbour; small star: the smaller ones and itself."""
    if small:
        pairs = links
    else:
        pairs = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = pairs.join(least, "u")
    if small:
        out = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("m < u").select("u", F.col("m").alias("v")))
    return out.distinct()


def connected_components(links: DataFrame, folder: str) -> DataFrame:
    """For links (a, b) of longs: node and root, the smallest node it is linked to, of all nodes but the roots.

    Each round is written to the folder; the number of rounds grows with the logarithm of the longest chain.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges = materialize(edges, f"{folder}/round-0")
    seen = None
    for k in range(1, 200):
        edges = materialize(_star(_star(edges, False), True), f"{folder}/round-{k}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError("components did not settle")
