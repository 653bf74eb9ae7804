"""Connected components of a graph of links, by rounds of Spark joins.

Rounds of large-star and small-star turn every component into a star around its
least node. Links live in written tables; the driver sees one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import materialize, release


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links every neighbour (large: above the node; small: below it) to the least one.

    The least neighbour comes from an aggregate that is joined back, not from a
    window, so that a node with very many neighbours can be split among tasks.
    """
    if large:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b"))
    else:
        out = joined.where("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b")).union(least.where("root <> a").select("a", F.col("root").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """node, component for every node of ``links`` (a, b): the least node it reaches.

    Links of a node to itself and links with a null end are ignored; repeated
    links count once; no links give an empty result.
    """
    now = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        seen = now.agg(F.count("*").alias("links"), F.countDistinct("a").alias("nodes")).first()
        # a forest of stars: each node above a root has one link, and no root has one itself
        if seen["links"] == seen["nodes"] and now.join(now.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
        before, now = now, materialize(_star(_star(now, large=True), large=False), "links")
        release(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
