"""Connected components of a table of links, by alternating large and small stars.

Each round is joins and grouped minima over links, stored in the shared folder; nothing is collected
but a count and a checksum to see when a round has changed nothing. Rounds grow with the logarithm of
the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (u > v) hung on the least neighbour: large stars move larger neighbours, small stars the others."""
    if large:
        near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """node, component: for each node of links (a, b), the least node that it reaches. Links of a node to itself count
    for nothing; direction and repeats do not matter; nodes without links are not in the result."""
    now = links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct()
    now = stored(now, "links")
    state = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    before = state(now)
    while before["n"]:
        now = stored(_star(_star(now, True).where("u <> v").distinct(), False).where("u <> v").distinct(), "links")
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
