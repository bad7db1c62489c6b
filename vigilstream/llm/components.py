"""Connected components of a table of links, by alternating large and small stars.

Each step turns a node's links into a star around the least node it knows; a few steps (about the logarithm of the
longest path) leave one star a component. Every step is written to the shared folder, so nothing is recomputed when
executors are lost, and only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilstream.llm.shared import forget, written

STEPS = 60


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least node) of every node that a link (columns a and b) names.

    Links may be repeated and go either way; a null end makes a link void; a link to itself names its node.
    """
    links = links.select("a", "b").where("a is not null and b is not null")
    alone = written(links.where("a = b").select(F.col("a").alias("node")).distinct(), "alone")
    links = written(links.where("a <> b").distinct(), "links")
    state = _state(links)
    for _ in range(STEPS):
        before, links = links, written(_small_star(_large_star(links)), "stars")
        forget(before)
        new = _state(links)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    centres = links.select(F.col("b").alias("node")).union(alone).distinct()
    centres = centres.join(links.select(F.col("a").alias("node")), "node", "left_anti")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(centres.select("node", F.col("node").alias("component")))
