"""Connected components of links by alternating stars, as joins and sums.

Links are a written table of (a, b). Each round attaches larger neighbours to the smallest one
and then smaller ones likewise; a node with many links is a hot key of a join, which adaptive
execution splits, and the minimum over its neighbours is taken before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteflow.staging import cut_lineage

MOST_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links`` holds (u, v) with u > v. Large: every u's larger neighbours get its smallest."""
    both = links if not large else links.unionByName(
        links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least"))
    least = least.select(F.col("u").alias("c"), F.least("least", "u").alias("m"))
    joined = both.join(least, F.col("u") == F.col("c"))
    moved = joined.where(F.col("v") > F.col("u") if large else F.col("v") > F.col("m"))
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.where("c > m").select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node with a link; ``component`` is the smallest node reachable.

    ``links`` has columns ``a`` and ``b`` of one comparable type; order, repeats, nulls and links
    of a node with itself do not matter.
    """
    links = links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = cut_lineage(links, "links")
    before = _mark(links)
    if not before[0]:
        return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(MOST_ROUNDS):
        links = cut_lineage(_star(_star(links, large=True), large=False), "stars")
        now = _mark(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    members = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
