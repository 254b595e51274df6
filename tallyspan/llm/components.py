"""Connected components of a table of links, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def least_neighbour(links: DataFrame) -> DataFrame:
    """(u, v, m): each link with the smallest of u and its neighbours."""
    least = links.groupBy("u").agg(F.min("v").alias("least"))
    return links.join(least.withColumnRenamed("u", "of"), F.col("u") == F.col("of")).select("u", "v", F.least("u", "least").alias("m"))


def large_star(links: DataFrame) -> DataFrame:
    """Each node points its larger neighbours to the smallest node that it sees."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Each node points its smaller neighbours and itself to the smallest of them (links run down: u > v)."""
    seen = least_neighbour(links)
    return seen.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each node of a link (a, b) the smallest node that it reaches.

    Nodes are whole numbers; loops and repeated links don't matter; no links, no rows. Every round is
    written to the shared folder. No step gathers a node's neighbours in one value, so hubs are fine.
    """
    links = staged(
        links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct(), "links"
    )
    before = fingerprint(links)
    while before[0]:
        large = staged(large_star(links), "large-star")
        small = staged(small_star(large), "small-star")
        for done in (links, large):
            discard(done)
        links = small
        now = fingerprint(links)
        if now == before:
            break
        before = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return staged(links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
