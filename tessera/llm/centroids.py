"""Centroid clustering of whole-number vectors, by built-in expressions alone.

The centroids are literal arrays in the plan: ``zip_with`` and ``aggregate`` give the exact squared distance to each,
``array_min`` over structs of distance and number chooses one, and one grouping with a sum for each component moves them.
A round reads the vectors once, where they lie, and shuffles a row of sums for each centroid and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: Components are held within this, so that no distance of up to 128 components leaves a long.
LARGEST = 1 << 27


def grid_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, scale: int = 256) -> DataFrame:
    """``vec_id, whole``: floor(scale * x) of the components of each vector of exactly ``size``.

    Vectors of another size, null or with a null or non-finite component are left out.  A null id stays null.
    Components beyond 2 ** 27, either way, count as that.
    """
    v = F.col(vector_col)
    sound = v.isNotNull() & (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    floor = F.transform(v, lambda x: F.floor(F.greatest(F.least(F.lit(float(scale)) * x.cast("double"), F.lit(float(LARGEST))), F.lit(float(-LARGEST)))))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), floor.alias("whole"))


def literal_arrays(rows: list[list[int]]) -> Column:
    return F.expr("array(" + ", ".join("array(" + ", ".join(f"{x}L" for x in row) + ")" for row in rows) + ")")


def nearest(vector: Column, centroids: list[list[int]]) -> Column:
    """Struct of the squared ``distance`` to the nearest centroid and its number, ``cluster``; ties go to the smaller number."""

    def distance(centroid: Column) -> Column:
        squares = F.zip_with(vector, centroid, lambda x, y: (x - y) * (x - y))
        return F.aggregate(squares, F.lit(0).cast("long"), lambda total, x: total + x)

    each = F.transform(literal_arrays(centroids), lambda c, i: F.struct(distance(c).alias("distance"), i.cast("int").alias("cluster")))
    return F.array_min(each)


def first_centroids(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The ``k`` vectors whose ids hash lowest; equal hashes are in order of the vectors.  No more than ``k`` rows are fetched."""
    place = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r.whole) for r in vectors.orderBy(place, "whole").select("whole").limit(k).collect()]


def moved(vectors: DataFrame, centroids: list[list[int]], size: int) -> list[list[int]]:
    """The floor of the mean of each centroid's vectors; a centroid without any stays.  As many rows as centroids are fetched."""
    sums = [F.sum(F.get("whole", F.lit(j))).alias(f"s{j}") for j in range(size)]
    found = vectors.select(nearest(F.col("whole"), centroids)["cluster"].alias("cluster"), "whole").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect()
    after = list(centroids)
    for r in found:
        after[r.cluster] = [r[f"s{j}"] // r.n for j in range(size)]
    return after


def cluster_vectors(vectors: DataFrame, *, k: int = 40, rounds: int = 5, size: int = 64, salt: str = "2:") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each row of ``vec_id, whole``.

    The first centroids are the ``k`` vectors (all, if fewer) of the lowest SHA-256 of ``salt`` and id.  ``rounds`` times
    every vector goes to its nearest centroid and each centroid to the floor of its vectors' mean; then vectors are
    assigned once more.  Inertia is the sum of squared distances, null beyond a long.  The hash is of the final
    centroid's components in decimal, joined by commas.

    Repeated rows and ids count each; a null id hashes as an empty one; other columns are ignored; no vectors give no
    rows.  All of ``whole`` must have ``size`` components, as ``grid_vectors`` leaves them.
    """
    scratch = Scratch(vectors.sparkSession, "centroids")
    held = scratch.write(vectors.select("vec_id", "whole"), "vectors")
    centroids = first_centroids(held, k, salt)
    if not centroids:
        return held.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        centroids = moved(held, centroids, size)
    found = held.select("vec_id", nearest(F.col("whole"), centroids).alias("n")).select("vec_id", "n.cluster", "n.distance")
    assigned = scratch.write(found, "assigned")
    scratch.drop("vectors")
    sums = assigned.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    digests = F.transform(literal_arrays(centroids), lambda c: F.sha2(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), 256))
    total = F.try_sum("cluster_inertia").over(Window.partitionBy())  # over at most k rows
    told = sums.withColumn("inertia", total).withColumn("centroid_sha256", F.get(digests, F.col("cluster")))
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
