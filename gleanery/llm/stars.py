"""Connected components by alternating large and small stars, all in DataFrames.

Every round rewrites the links so that each node points at the least node it knows of; the links end as stars
around each component's least node. Rounds are cut by reliable checkpoints, and no link reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleanery.session import durable


def _large(links: DataFrame) -> DataFrame:
    """Each node's greater neighbours are linked to the least of the node and its neighbours."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    moved = both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("u"))
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Each node and its lesser neighbours are linked to the least of these; links point from greater to lesser."""
    down = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    moved = down.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b) that is not the least of its component, which is its root."""
    links = durable(links.where("a <> b").select("a", "b").distinct())
    mark = None
    while True:
        links = durable(_small(_large(links)))
        # order-free and 128 bits wide: equal marks mean equal links
        now = links.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("x"),
            F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("y"),
        ).first()
        if now == mark:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
