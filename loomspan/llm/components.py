"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.session import cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the least node that it is linked with.

    Each round connects every node's larger neighbours, then its smaller ones,
    to the least node it sees; distances halve, so that rounds grow with the
    logarithm of the longest path, and ends when a round changes nothing. Every
    round is cut from the one before.
    """
    current = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    before = None
    while True:
        around = _both(current)
        least = around.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("least"))
        large = around.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).where("src <> dst").distinct()
        lower = large.groupBy("src").agg(F.min("dst").alias("least"))
        small = large.join(lower, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
        small = small.unionByName(lower.select("src", F.col("least").alias("dst"))).where("src <> dst").distinct()
        current = cut(small)
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).collect()[0]
        if tuple(seen) == before:
            break
        before = tuple(seen)
    roots = current.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return current.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
