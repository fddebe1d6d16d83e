"""Centroid clustering of integer vectors, exact (operator 13).

Vectors are packed in blocks of BLOCK rows, each a number matrix, and stored once. A round assigns block by block: the squared
distances |x|^2 - 2 x.c + |c|^2 come from one product of matrices in float64, which is exact while all of its parts stay below 2^53;
the largest component of the block and of the centroids tells whether they do. Where they do not, differences are taken in
64-bit integers, and beyond 2^63 in Python's integers. Sums and counts a cluster meet by RDD.treeAggregate, so the driver gets one small
table of exact integers a round, whatever the number of vectors. Nothing but the centroids goes back to the tasks.

Edge cases: vectors that are null, have another length, or hold null or non-finite components (also once scaled) are left out, and rows
with them are not returned; a null id hashes as an empty string; among equal hashes (repeated ids) the smaller vector starts first; repeated rows are rows of
their own; fewer vectors than centroids give as many centroids as there are vectors; distances and inertias beyond a long are given as the largest long;
empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import stored

BLOCK = 4096
LONG = (1 << 63) - 1


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest of int16, int32 and float64 that holds them."""
    top = np.abs(x).max(initial=0.0)
    return x.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.float64)


def exact(x: np.ndarray) -> np.ndarray:
    """Whole numbers of any size as Python's integers."""
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c, whole numbers: float64, int64 or Python's integers, exact in each."""
    d, reach = x.shape[1], int(np.abs(x).max(initial=0)) + max((abs(int(v)) for v in c.ravel()), default=0)
    if d * reach * reach < 1 << 53:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
    if d * reach * reach < 1 << 63:
        x, c = x.astype(np.int64), np.array([[int(v) for v in row] for row in c], np.int64)
    else:
        x, c = exact(x), exact(c)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def sums(x: np.ndarray, cluster: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each cluster the sum of its vectors, in Python's integers, and their number."""
    count = np.bincount(cluster, minlength=k)
    if len(x) * int(np.abs(x).max(initial=0)) < 1 << 53:
        own = (cluster == np.arange(k)[:, None]).astype(np.float64) @ x.astype(np.float64)
        return exact(own), count.astype(object)
    own = np.zeros((k, x.shape[1]), object)
    np.add.at(own, cluster, exact(x))
    return own, count.astype(object)


def packed(df: DataFrame, d: int, scale: int, vec_id: str, embedding: str) -> tuple[DataFrame, DataFrame]:
    """The kept rows (id, v), and their blocks (ids, kind, data), stored."""
    v = F.col(embedding).cast("array<double>")
    fine = (F.size(v) == d) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (F.abs(x) < np.finfo(np.float64).max / scale))
    kept = df.select(F.col(vec_id).alias("id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                x = narrow(np.floor(part.column("v").flatten().to_numpy().reshape(-1, d) * scale))
                yield pa.RecordBatch.from_pydict({"ids": pa.array([part.column("id").to_pylist()], pa.list_(part.column("id").type)), "kind": [x.dtype.str], "data": [x.tobytes()]})

    return kept, stored(kept.mapInArrow(pack, f"ids array<{df.schema[vec_id].dataType.simpleString()}>, kind string, data binary"), "vector-blocks")


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, d: int = 64, scale: int = 256, seed: int = 2, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector."""
    spark, kind = df.sparkSession, df.schema[vec_id].dataType.simpleString()
    kept, blocks = packed(df, d, scale, vec_id, embedding)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = kept.select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    centroids = exact(np.floor(np.array([r.v for r in start], np.float64).reshape(-1, d) * scale))
    matrix = lambda r: np.frombuffer(r["data"], r["kind"]).reshape(-1, d)
    rows = blocks.select("kind", "data").rdd

    def added(a, b):
        return b if a is None else a if b is None else (a[0] + b[0], a[1] + b[1])

    for _ in range(rounds if start else 0):
        def assign(total, row, c=centroids):
            x = matrix(row)
            return added(total, sums(x, distances(x, c).argmin(1), len(c)))

        total, count = rows.treeAggregate(None, assign, added)
        centroids = np.stack([t // n if n else c for t, n, c in zip(total, count, centroids, strict=True)])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                near = distances(matrix(row), centroids)
                at = near.argmin(1)
                least = near[np.arange(len(at)), at]
                yield pa.RecordBatch.from_pydict({"id": row["ids"], "cluster": pa.array(at, pa.int32()), "distance": pa.array([min(int(x), LONG) for x in least], pa.int64())}, schema=pa.schema([("id", batch.column("ids").type.value_type), ("cluster", pa.int32()), ("distance", pa.int64())]))

    found = stored(blocks.mapInArrow(finish, f"id {kind}, cluster int, distance long"), "clusters")
    inertia = {r.cluster: int(r.n) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}  # k rows at most
    shown = [(i, min(inertia[i], LONG), min(sum(inertia.values()), LONG), hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest()) for i in inertia]
    table = spark.createDataFrame(shown, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select(F.col("id").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
