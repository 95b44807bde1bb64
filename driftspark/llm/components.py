"""Connected components of a graph given as links, by large and small stars.

Each round points every node at the least node it knows; the number of rounds
grows with the logarithm of the longest path, and no node's neighbours are
ever gathered in one place: both steps are a minimum per node and a join, and
Spark splits the large keys of these joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import checkpointed


def star(links: DataFrame, larger: bool) -> DataFrame:
    """One step on links (u, v). ``larger``: neighbours above a node are
    linked to the least of node and neighbours; else those below it, and
    itself."""
    if larger:
        near = links.union(links.select("v", "u"))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = near.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        near = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        out = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root), root the least node of its component, for every node of
    the links (u, v). Nodes without links do not appear; null nodes are left
    out. Each round is a checkpoint in the shared folder."""
    now = checkpointed(links.where(F.col("u") != F.col("v")).distinct())
    while True:
        now = checkpointed(star(star(now, True), False))
        # done when no node has two targets and no target points further
        pointing = now.select("u").agg(F.count("*").alias("n"), F.countDistinct("u").alias("d")).first()
        if pointing["n"] == pointing["d"] and now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
