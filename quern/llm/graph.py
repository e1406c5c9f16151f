"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, gathered, materialize


def components(links: DataFrame) -> DataFrame:
    """``links`` has a and b; returns each linked node as ``a`` with the smallest node of its component as ``b`` (a > b).

    Every step joins and aggregates by node, so nothing is gathered. What a join
    needs of each node is a table of its own, one row a node after map-side
    combine; so both sides of the join are plain exchanges, and a node with very
    many links is split as a skewed key. The steps end when each node is linked with
    its smallest alone, after rounds that are logarithmic in the size of a component.
    """

    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    n = edges.count()  # links never grow more than twofold, so tasks are as many as these need
    few = lambda df: gathered(df, 2 * n)
    while n and not _settled(edges, n):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(few(both.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.first("a")).alias("m"))), "least")
        large = both.join(least, F.col("a") == F.col("c")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = materialize(few(large.groupBy(F.col("a").alias("d")).agg(F.min("b").alias("l"))), "low")
        small = large.join(low, F.col("a") == F.col("d")).where("b > l").select(F.col("b").alias("a"), F.col("l").alias("b"))
        further = materialize(few(small.unionByName(low.select(F.col("d").alias("a"), F.col("l").alias("b"))).distinct()), "links")
        discard(edges, least, low)
        edges = further
    return edges


def _settled(edges: DataFrame, n: int) -> bool:
    """Whether the links are stars already: each node has one smaller one, or is the smallest of others."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    sides = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return gathered(sides.where("up > 1 OR (up = 1 AND down = 1)"), 2 * n).count() == 0
