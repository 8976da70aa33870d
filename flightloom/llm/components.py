"""Connected components of a table of links, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightloom.llm.common import forget, scratch, stash


def stars(links: DataFrame) -> bool:
    """Whether each node has one link to a smaller one, or none and only greater ones linked to it: no round changes such links."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    held = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return held.agg(F.count(F.when((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)), 1))).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node linked to it, itself included) of every node of the links (a, b).

    Large-star and small-star rounds: each brings nodes nearer to the smallest of their neighbourhood, by one
    aggregation and one join on a node, and the rounds end when all links are stars. Links are written between rounds.
    """
    spark = links.sparkSession
    with scratch(spark) as made:
        links = stash(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
        while not stars(links):
            both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
            large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(least, "a")
            links = stash(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "links")
            forget(spark, made[:-1])
            del made[:-1]
        made.clear()
    roots = links.select("b").distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("component")))


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """components() of the links that gave ``found`` and of further ones (a, b), from rounds over the further ones alone, whose ends stand for their components."""
    of = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    upper = components(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    moved = found.join(upper.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left")
    return moved.select("node", F.coalesce("least", "component").alias("component")).unionByName(upper.join(found.select("node"), "node", "left_anti"))
