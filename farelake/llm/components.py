"""Connected components of a link table by alternating large-star and small-star steps.

Every step is joins and minima per node; a hot node's rows are summed up in each
task before the shuffle, and a hot join key is split by adaptive execution. Each
round is written to the shared scratch folder. The number of rounds grows with
the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farelake.session import durable


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    both = _both_ways(links)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return (both.join(least, "a").where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("least").alias("b")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = (down.join(least, "a").where(F.col("b") != F.col("least"))
             .select(F.col("b").alias("a"), F.col("least").alias("b")))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long, a != b); the component is its smallest node."""
    links = durable(links.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "links")
    state = _state(links)
    while True:
        links = durable(_small_star(_large_star(links)), "stars")
        new = _state(links)
        if new == state:
            break
        state = new
    return (links.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())
