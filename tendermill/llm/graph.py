"""Connected components by alternating stars, with joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendermill.llm.store import checkpointed


def _with_least(links: DataFrame) -> DataFrame:
    """Each (u, v) with the least of u and its neighbours; partial minima first, so a hot u is met by joins only."""
    least = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return links.join(least, "u")


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component_id) for every node with a link; the id is the least node that links reach.

    Large stars hang every larger neighbour on the least one, small stars every smaller one; the number
    of rounds grows with the logarithm of the number of nodes. Nulls and self-links are left out.
    """
    a, b = F.col(left), F.col(right)
    edges = links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, before = checkpointed(edges), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        small = _with_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = checkpointed(small.where(F.col("u") != F.col("v")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct())
        before = now
