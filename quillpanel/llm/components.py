"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable


def _least(edges: DataFrame, of: str, other: str) -> DataFrame:
    return edges.groupBy(of).agg(F.min(other).alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = _least(both, "a", "b").withColumn("m", F.least("a", "m"))
    large = both.join(near, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = _least(large, "a", "b")
    small = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(least.withColumnRenamed("m", "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) with the least member b of a's component, for every a but the least members.

    links: (a, b) of any one ordered type. Each round is written to the shared folder, so a lost
    executor costs one round at most, and the rounds grow with the logarithm of the longest chain.
    """
    ordered = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, before = durable(ordered.distinct()), None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or state[0] == 0:
            return edges
        after = durable(_round(edges))
        discard(edges.sparkSession, [edges.durable_path])
        edges, before = after, state
