"""Connected components of a graph, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def nearest_root(pairs: DataFrame) -> DataFrame:
    """Each node's least neighbour or itself: ``node``, ``least``.

    Summed before the shuffle, so that a node of very many links stays cheap.
    """
    both = pairs.select(F.col("u").alias("node"), F.col("v").alias("other")).union(pairs.select("v", "u"))
    return both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("least"))


def components(edges: DataFrame) -> DataFrame:
    """Component of every node that has a link.

    ``edges`` has the integer columns ``u`` and ``v``; order, repeats and loops
    don't matter. Returns ``node`` and ``root``, the least node that can be
    reached from it. In each round every link (u, v) becomes links of its ends to
    the least neighbour of the other end, which at least halves the distances
    to the least node (alternating stars); rounds end when each link is
    (node, root). Links are cut into the shared folder after each round and are
    never collected; an empty table gives none.
    """
    links = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while not links.isEmpty():
        # Large star: what is linked to u and lies above it goes to u's least neighbour.
        # Read from the shared folder on both sides, the rows of a node of very many links are split.
        least = cut(nearest_root(links))
        large = links.join(least, links.v == least.node).select("u", F.col("least").alias("v")).distinct()
        # Small star: of the lower neighbours of u the least takes the others and u.
        lower = large.groupBy("u").agg(F.min("v").alias("root"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct("u", F.col("root").alias("v")), F.struct(F.col("v").alias("u"), F.col("root").alias("v")))).alias("link")).select("link.*").where("u <> v").distinct()
        new = cut(small)
        # Done when every u has one v and no v is a u.
        roots = new.select(F.col("v").alias("u")).distinct()
        links = new
        if new.count() == new.select("u").distinct().count() and new.join(roots, "u", "left_semi").isEmpty():
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select("v", "v").distinct())
