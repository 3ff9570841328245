"""Connected components of links, by alternating large and small stars.

Every round replaces links by links to the smallest neighbour, with a minimum by node (aggregated map-side first) and a join
that Spark splits where a node is hot; no neighbour list is ever gathered. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime


def _star(links: DataFrame, small: bool) -> DataFrame:
    """links: a > b. Large: the larger neighbours of each node go to the node's minimum. Small: the smaller ones, and itself."""
    if small:
        low = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return low.select("a", F.col("m").alias("b")).unionByName(moved).distinct()
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return links.select(F.col("b").alias("u"), F.col("a").alias("v")).join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one link upwards or only links from below."""
    ends = links.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("b").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").limit(1).count()


def components(links: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """links: columns a and b. Returns node and root, the smallest node that links reach, for nodes that aren't their own root.

    of: a table that the links grow with, for their number of partitions; the links themselves where there is none."""
    now = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    of = links if of is None else of
    now = runtime.materialize(now, "links", of, runtime.NARROW)
    while not _are_stars(now):
        before, now = now, runtime.materialize(_star(_star(now, False), True), "links", of, runtime.NARROW)
        runtime.discard(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
