"""Clusters of integer vectors around centroids (operator 12).

Components become whole numbers, so the nearest centroid, its distance and every new centroid are exact and the same on every
cluster. Products of vectors and centroids are computed in float32 as one matrix product for a batch; with each comes a bound of
its rounding error, from which the interval follows that holds the true value. Centroids whose interval reaches below
the least upper end are the shortlist. Where it holds one, that is the nearest; else the squared distances of the shortlist are
computed in whole numbers, and of equal ones the smallest number wins.

A round is one pass over the vectors: each task adds up its vectors by cluster and returns one row for each, which Spark
adds up by component; k rows of sums come to the driver, however many vectors there are.

Kept are vectors of exactly the asked number of components, none null, NaN or infinite. Components of 2**27 or more after
scaling are refused with an error, since their squared distances would not fit a long. With fewer than k vectors there are as
many centroids; an empty table gives an empty result. vec_ids that repeat or are null have rows of their own (null ones come
last in the choice of first centroids, equal ones in order of their components). Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import cut

#: Components stay below this, so that distances over up to 64 of them fit 63 bits.
MOST = 1 << 27
#: Unit roundoff of float32.
ROUND = 2.0**-24


def whole_vectors(vectors: DataFrame, components: int, scale: float) -> DataFrame:
    """vec_id and v, whole numbers, of the vectors that are kept."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.where((F.size("embedding") == components) & finite)
    number = lambda x: F.floor(x.cast("double") * scale)
    fits = lambda x: F.when(F.abs(x.cast("double") * scale) < float(MOST), number(x)).otherwise(F.raise_error(F.lit(f"a component of {MOST} or more after scaling")).cast("long"))
    return kept.select("vec_id", F.transform("embedding", lambda x: fits(x).cast("int")).alias("v"))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row of x (int64) the nearest row of centroids, the squared distance, and how many rows had a shortlist of more
    than one."""
    d = x.shape[1]
    norms, own = (centroids**2).sum(1), (x**2).sum(1)
    dot = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    # Conversion to float32 and a sum of d products in any order: a factor of (1 + ROUND) at most d + 2 times.
    gamma = (d + 2) * ROUND / (1 - (d + 2) * ROUND)
    error = 2 * gamma * np.sqrt(own)[:, None] * np.sqrt(norms)[None, :]
    score = norms[None, :] - 2 * dot  # the squared distance without the vector's own norm
    error = error * (1 + 2.0**-40) + 2.0**-50 * (norms[None, :] + 2 * np.abs(dot))  # of the few steps in float64
    shortlist = score - error <= (score + error).min(1)[:, None]
    best = shortlist.argmax(1)
    open_rows = np.flatnonzero(shortlist.sum(1) > 1)
    if len(open_rows):
        r, c = np.nonzero(shortlist[open_rows])  # by row, then by number
        exact = np.full((len(open_rows), len(centroids)), np.iinfo(np.int64).max)
        exact[r, c] = ((x[open_rows[r]] - centroids[c]) ** 2).sum(1)
        best[open_rows] = exact.argmin(1)  # the first of equal ones
    return best, ((x - centroids[best]) ** 2).sum(1), len(open_rows)


def matrix(column: pa.Array, components: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, components)


def sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """By cluster: how many vectors, and the sum of each component."""
    k, d = centroids.shape

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = matrix(batch.column(0), d)
            best, _, _ = nearest(x, centroids)
            for j in np.unique(best):
                total[j] += x[best == j].sum(0)
                n[j] += (best == j).sum()
        rows = [{"cluster": int(j), "sums": [int(n[j]), *total[j].tolist()]} for j in np.flatnonzero(n)]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("cluster", pa.int32()), ("sums", pa.list_(pa.int64()))]))

    parts = vectors.select("v").mapInArrow(of_task, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("at", "x"))
    added = parts.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x")).collect()  # k * (d + 1) rows at most
    found: dict[int, list[int]] = {}
    for r in added:
        found.setdefault(r.cluster, [0] * (d + 1))[r["at"]] = int(r.x)
    return {j: (s[0], s[1:]) for j, s in found.items()}


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select("v", key.alias("key")).orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()
    return np.array([list(r.v) for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, components: int = 64, scale: float = 1024.0, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (its components), centroid_sha256 for each kept vector of
    vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    kept = cut(whole_vectors(vectors, components, scale))
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    for _ in range(rounds):
        for j, (n, total) in sums(kept, centroids).items():
            centroids[j] = [s // n for s in total]

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, distance, _ = nearest(matrix(batch.column(1), components), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    kind = kept.schema["vec_id"].dataType.simpleString()
    found = cut(kept.mapInArrow(of_batch, f"vec_id {kind}, cluster int, distance long"))
    by = {r.cluster: int(r.inertia) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("inertia")).collect()}  # k rows
    total = sum(by.values())
    rows = [(j, n, total, centroids[j].tolist(), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, n in sorted(by.items())]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
