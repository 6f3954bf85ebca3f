"""Connected components of pairs, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewspark.storage import rewritten


def _least_of(edges: DataFrame) -> DataFrame:
    """edges (a, b) with the least neighbour of a, or a itself."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").withColumn("m", F.least("a", "m"))


def _large(edges: DataFrame) -> DataFrame:
    """Greater neighbours of a vertex are hung on its least one."""
    both = edges.union(edges.select("b", "a"))
    return _least_of(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Lesser neighbours of a vertex, and itself, are hung on its least one."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    own = _least_of(down)
    return own.select("a", "m").union(own.select("b", "m")).toDF("a", "b").where("a <> b").distinct()


def connected(pairs: DataFrame) -> DataFrame:
    """vertex and component (its least vertex) of all vertices that have a pair (a, b).

    Edges are turned towards least neighbours by large and small stars in turn (Kiveris et al. 2014),
    until each component is one star; chains shorten by a factor in each round.  Each round is written
    to the shared folder; only counts and checksums reach the driver.
    """
    edges = rewritten(pairs.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            break
        seen = state
        edges = rewritten(_small(rewritten(_large(edges))))
    heads = edges.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(heads)
