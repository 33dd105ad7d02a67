"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a join and an aggregate over the links, so nothing is collected; the links after each
round are written to the shared folder. A hub's links are spread by AQE's skew join and its smallest
neighbour comes from a combined ``min``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.llm.common import delete_path, written


def large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Links point from larger to smaller."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b): every linked node but the smallest of its component, and that smallest node. Links are pairs of longs, any way round."""
    spark = links.sparkSession
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    now, path = written(pairs, "links")
    state = None
    while True:
        after, new_path = written(small_star(large_star(now)), "links")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        delete_path(spark, path)
        now, path = after, new_path
        if mark == state:
            return now
        state = mark
