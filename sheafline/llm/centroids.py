"""Centroid clustering (k-means) in integers, in DataFrame expressions only.

A vector's components become integers; its distance to each centroid, a literal
array, is a ``zip_with`` and an ``aggregate``; the least (distance, number) of
``array_min`` is its cluster.  One sum for each component and cluster, combined
on the map side, updates the centroids, so that a round moves at most ``k`` rows
a task and the driver sees ``k`` rows.  All arithmetic is in whole numbers and
does not depend on the order of the rows.

Left out: rows whose vector is null, has another number of components than
``width`` or holds a null or non-finite one.  Repeated rows count each time.  Rows
without ``vec_id`` are clustered like others; among the starts they come after all
rows that have one, and equal hashes are ordered by the vector.  With fewer than
``k`` vectors there are fewer centroids; no vectors give no rows.  A component
whose integer is beyond ``LIMIT`` either way counts as ``LIMIT`` (with its sign), so
that no distance leaves a long; an inertia beyond a long is given as the greatest
one.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import working_tables, written

#: (2 * LIMIT) ** 2 * 64 is below 2 ** 63.
LIMIT = 1 << 27
LONG = (1 << 63) - 1
SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"

Centroid = tuple[int, ...]


def whole_vectors(vectors: DataFrame, width: int, scale: int) -> DataFrame:
    """``vec_id`` and ``x``, the components as integers, of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), v * float(scale)))))
    return vectors.where((F.size("embedding") == width) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def starts(vectors: DataFrame, k: int, salt: str) -> list[Centroid]:
    """The ``k`` vectors with the smallest hash of ``salt:vec_id``."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    return [tuple(r.x) for r in vectors.orderBy(order.asc_nulls_last(), "x").limit(k).select("x").collect()]


def nearest(centroids: list[Centroid]) -> Column:
    """The struct (distance, cluster) of the nearest centroid of ``x``."""

    def distance(c: Centroid) -> Column:
        literal = F.expr(f"array({', '.join(f'{v}L' for v in c)})")
        return F.aggregate(F.zip_with("x", literal, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda total, v: total + v)

    return F.array_min(F.array(*(F.struct(distance(c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids))))


def moved(vectors: DataFrame, centroids: list[Centroid]) -> list[Centroid]:
    """The centroids after one round: floor of the mean, empty ones as they are."""
    sums = [F.sum(F.get("x", F.lit(j))).alias(f"s{j}") for j in range(len(centroids[0]))]
    rows = vectors.select("x", nearest(centroids)["cluster"].alias("cluster")).groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect()
    means = {r.cluster: tuple(s // r.n for s in r[2:]) for r in rows}
    return [means.get(i, c) for i, c in enumerate(centroids)]


def digest(centroid: Centroid) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, salt: str = "1") -> DataFrame:
    """One row for each vector that takes part: its cluster after ``rounds`` updates and what the clusters add up to."""
    spark = vectors.sparkSession
    with working_tables(spark) as keep:
        whole = written(whole_vectors(vectors, width, scale), "whole-vectors")
        centroids = starts(whole, k, salt)
        if not centroids:
            return spark.createDataFrame([], SCHEMA)
        for _ in range(rounds):
            centroids = moved(whole, centroids)
        found = keep(written(whole.select("vec_id", nearest(centroids).alias("near")).select("vec_id", "near.cluster", "near.distance"), "clusters"))
        inertia = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
        rows = [(i, min(inertia.get(i, 0), LONG), min(sum(inertia.values()), LONG), digest(c)) for i, c in enumerate(centroids)]
        facts = F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
        return found.join(facts, "cluster").select(*(n.split()[0] for n in SCHEMA.split(", ")))
