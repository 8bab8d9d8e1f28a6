"""Connected components of a table of links by large-star and small-star steps.

Each step is one grouping and one join by node, both with map-side sums or skew-splitting joins, so a
hub with many links is no single task's work. Tables are cut after each step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portrisk.llm.common import cut


def _signature(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for every node of links (a, b) except roots themselves."""
    now = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (mark := _signature(now)) != before:
        before = mark
        # Large star: neighbours above a node hang on the least node of its neighbourhood.
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["u"]).where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large)
        # Small star: a node and its lower neighbours hang on the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        joined = large.join(least, large["a"] == least["u"])
        now = cut(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
