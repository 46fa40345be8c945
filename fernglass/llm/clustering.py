"""Centroid clustering of vectors in whole numbers: squared differences are tabulated, distances are table gathers and sums."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.llm import common

#: Vectors whose distances a task holds at once: with 40 centroids 2.6 MB.
BLOCK = 8192
#: Components of this size or more are left out: squared distances of 64 such don't fit a long.
LARGEST = float(1 << 19)


def quantised(vectors: DataFrame, *, dims: int, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v: floor(scale * x) of each component, as a double is multiplied; vectors that may be clustered only.

    Left out: null vectors, vectors of another length than `dims`, and those with a component that is null, not finite, or
    LARGEST or more in size.
    """
    x = F.transform(F.col(embedding), lambda c: c.cast("double"))
    fine = (F.size(embedding) == dims) & F.forall("x", lambda c: F.coalesce(F.abs(c) < F.lit(LARGEST), F.lit(False)) & ~F.isnan(F.coalesce(c, F.lit(float("nan")))))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias(embedding), x.alias("x")).where(F.col("x").isNotNull() & fine)
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("int")).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `seed:vec_id`, in its order; null ids come last, equal ids by their vectors."""
    hashed = rows.select(F.sha2(F.concat(F.lit(seed + ":"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    return [r.v for r in hashed.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]


def distances(block, centroids):
    """Squared distances of integer vectors (rows) to centroids. Each dimension has a table: a row for each value that occurs
    in the block, a column for each centroid; its rows are gathered by the vectors' values and added up."""
    import numpy as np

    out = np.zeros((len(block), len(centroids)), np.int64)
    for d in range(block.shape[1]):
        column = block[:, d]
        low, high = int(column.min()), int(column.max())
        if high - low < len(column):  # every value of the range has a row, so a value's place needs no search
            values, place = np.arange(low, high + 1, dtype=np.int64), column - low
        else:
            values, place = np.unique(column, return_inverse=True)
        table = values[:, None] - centroids[None, :, d]
        out += (table * table)[place]
    return out


def _blocks(batches, dims: int):
    """Arrow batches of (id, v) as (ids, matrix) of at most BLOCK vectors."""
    import numpy as np

    for b in batches:
        for i in range(0, b.num_rows, BLOCK):
            s = b.slice(i, BLOCK)
            yield s.column(0), s.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _sums(rows: DataFrame, centroids: list[list[int]], dims: int) -> dict[int, list[int]]:
    """The new centroid of each cluster that has vectors: exact floor(sum / count).

    A task gives one row for each cluster, so what is shuffled doesn't depend on the size of a cluster; those rows are added up in
    two levels.
    """

    def assign(batches):
        import numpy as np
        import pyarrow as pa

        c = np.array(centroids, np.int64)
        total, count = np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64)
        for _, m in _blocks(batches, dims):
            near = distances(m, c).argmin(axis=1)
            count += np.bincount(near, minlength=len(c))
            order = np.argsort(near, kind="stable")
            starts = np.searchsorted(near[order], np.arange(len(c)))
            has = np.flatnonzero(np.bincount(near, minlength=len(c)))
            total[has] += np.add.reduceat(m[order], starts[has], axis=0)
        has = np.flatnonzero(count)
        if len(has):
            yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(count[has]), pa.array(total[has].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    parts = rows.select("vec_id", "v").mapInArrow(assign, "cluster int, n long, s array<long>").withColumn("part", F.spark_partition_id() % 64)
    added = [F.sum("n").alias("n"), *(F.sum(F.col("s")[d]).alias(f"s{d}") for d in range(dims))]
    again = [F.sum("n").alias("n"), *(F.sum(f"s{d}").alias(f"s{d}") for d in range(dims))]
    got = parts.groupBy("cluster", "part").agg(*added).groupBy("cluster").agg(*again).collect()
    return {r.cluster: [r[f"s{d}"] // r.n for d in range(dims)] for r in got}


def cluster(vectors: DataFrame, *, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2", vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """Assigned vectors (vec_id, cluster, distance) and the final centroids, in whole numbers.

    Every round gives each vector to the centroid of the smallest squared distance (ties: the smaller number) and moves each
    centroid that has vectors to the floor of their mean. What reaches the driver is k * dims sums a round. Null and
    repeated ids are rows of their own; equal ids start as one, ordered by vector. With fewer than k vectors each of them is a
    centroid; with none the result is empty.
    """
    spark = vectors.sparkSession
    common.prepare(spark)
    rows = common.written(quantised(vectors, dims=dims, scale=scale, vec_id=vec_id, embedding=embedding), "quantised")
    kind = rows.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(rows, k, seed)
    for _ in range(rounds if centroids else 0):
        moved = _sums(rows, centroids, dims)
        centroids = [moved.get(i, c) for i, c in enumerate(centroids)]

    def assign(batches):
        import numpy as np
        import pyarrow as pa

        c = np.array(centroids, np.int64).reshape(-1, dims)
        for ids, m in _blocks(batches, dims):
            all_of = distances(m, c)
            near = all_of.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(near, pa.int32()), pa.array(all_of[np.arange(len(m)), near])], ["vec_id", "cluster", "distance"])

    return common.written(rows.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "assigned"), centroids


def report(spark: SparkSession, assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Each assigned vector with its cluster's and all clusters' inertia and its centroid's digest. A sum past a long is null."""
    inertia = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}
    whole = None if None in inertia.values() else sum(inertia.values())
    whole = None if whole is not None and whole >= 1 << 63 else whole
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    table = spark.createDataFrame([(i, s, whole, digest[i]) for i, s in sorted(inertia.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row for each of k clusters
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
