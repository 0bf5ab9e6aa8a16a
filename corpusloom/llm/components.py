"""Connected components of a table of links between 64-bit nodes, by alternating large-star and small-star steps.

Each step is a few aggregations and joins on a node, stored in the shared folder, until the links are stars around the least node
of each component. Neither links nor components come to the driver; minima are aggregated before they are shuffled, and a
hub's many links are salted where they meet its minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import discard, stored

SALTS = 8


def _large_star(links: DataFrame) -> DataFrame:
    """Links all larger neighbours of a node to the least of its neighbours and itself."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # A hub's links are dealt to SALTS partitions, its minimum to each of them.
    both = both.where("v > u").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return both.join(least.hint("merge"), ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links the smaller neighbours of a node, and itself, to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def labels(links: DataFrame) -> DataFrame:
    """(u, v) with v the least node of u's component, for every node u but those least ones; links: u, v with u != v."""
    links, before = stored(links.select("u", "v"), "links"), None
    while True:
        stars = stored(_small_star(_large_star(links)), "stars")
        discard(links)
        links = stars
        # Equal counts and sums of hashes in two rounds: nothing moved.
        state = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == before or not state[0]:
            return links
        before = state
