"""Connected components of a link table, as Spark jobs.

Rounds of large-star and small-star steps (Kiveris et al., 2014): each point
hooks its larger neighbours to the least neighbour, then its smaller ones.  The
table of links shrinks to stars around each component's least member, in a
number of rounds that grows with the logarithm of the component's size.  Every
round is written to the shared folder, so lineage stays short and a lost
executor costs one round's tasks.  Only counts come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def apart(column: str):
    """The same value, but no longer known to be partitioned by the column.

    A join on it then shuffles both sides, and Spark can split hot partitions.
    """
    return F.bitwise_not(F.bitwise_not(F.col(column))).alias(column)


def _hook(pairs: DataFrame, larger: bool) -> DataFrame:
    """One star step: (point, neighbour) rows to links from neighbours to the least."""
    least = pairs.groupBy("a").agg(F.min("b").alias("b")).select(apart("a"), F.least("a", "b").alias("m"))
    joined = pairs.join(least, "a")
    if larger:
        return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.select(F.col("b").alias("x"), F.col("a").alias("y"), "m").select(F.explode(F.array("x", "y")).alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))


def components(links: DataFrame) -> DataFrame:
    """``member, component`` for every id in ``links(a, b)``; the least id names it."""
    clean = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = written(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _hook(both, larger=True).where(F.col("a") != F.col("b")).distinct()
        small = _hook(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), larger=False).distinct()
        before, edges = edges, written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
        discard(before)
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == state:
            break
        state = tuple(new)
    stars = edges.groupBy(F.col("a").alias("member")).agg(F.min("b").alias("component"))
    heads = edges.select(F.col("b").alias("member")).distinct().withColumn("component", F.col("member"))
    return stars.unionByName(heads)
