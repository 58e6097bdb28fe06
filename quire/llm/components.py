"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import drop, save


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component.

    Every step is a grouped minimum and a join back, both spread over the nodes; the number of steps grows with
    the logarithm of the longest path.  Nothing is gathered on the driver but a count and a checksum.
    """
    now = save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    while not _stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "m").union(least.select(F.col("u").alias("v"), "m"))
        after = save(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc")
        drop(now)
        now = after
    # at rest every node but the roots points at its root
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node but the roots points at one root, and at nothing else."""
    role = edges.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("root")).union(edges.select("v", F.lit(0), F.lit(1)))
    bad = role.groupBy("x").agg(F.sum("child").alias("c"), F.max("root").alias("r")).where("c > 1 or (c = 1 and r = 1)")
    return bad.isEmpty()
