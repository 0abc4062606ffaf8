"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def _with_least(edges: DataFrame) -> DataFrame:
    """u, v and least: the smallest of u and all its v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("least", F.least("u", "m"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: the smallest node (long) that is linked to it, for every node of ``links`` (u long, v long).

    Each round ties every larger neighbour to the least one, then every smaller one (both need a logarithmic number of rounds at most).
    Only joins and minima are used, so a node of very many links is no large group. Links of a node to itself and repeated links
    count as one or none.
    """
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = stored(edges, "links"), None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        small = _with_least(large)
        small = small.select(F.col("v").alias("u"), F.col("least").alias("v")).union(small.select("u", F.col("least").alias("v"))).filter("u <> v")
        edges = stored(small.distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        before = now
    raise RuntimeError("the components have not settled")
