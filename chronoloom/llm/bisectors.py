"""Centroid clustering of integer vectors, where each assignment is a tournament of bisectors.

For centroids i < j the vector x is nearer to j exactly if ``x . 2(c_j - c_i) > |c_j|^2 - |c_i|^2``.  These integer
normals and thresholds are made once a round; a vector then takes k - 1 sign tests, each of which eliminates the loser
of a pair, and a test of zero favours the smaller number.  Only the winner's squared distance is computed.  All sums
are exact: floors of integer quotients, no floating point.

Every round is one pass over the stored vectors: a task returns counts and component sums of its own rows, Spark adds
them up per centroid, and k rows reach the driver.  Vectors are never grouped, so equal ones may be any number.

Vectors with another number of components, or with a component that is null or not finite, are left out; so are those
beyond ``LIMIT``, whose distances a long cannot hold.  Rows without an id are clustered and come last among those that
may start a centroid.  Equal hashes of ids (repeated rows) start centroids in the order of their vectors.  With fewer
than k vectors there are as many centroids as vectors; an empty table gives an empty result.  Only id and vector are
read, whatever else there is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.session import durable

SCALE, CENTROIDS, ROUNDS, COMPONENTS = 1024, 8, 10, 64
#: Largest size of a component after scaling: 64 squares of differences fit a long.
LIMIT = 1 << 27


def quantize(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v``, the vectors kept, as integers."""
    x = F.col(vector_col).cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float(LIMIT // SCALE))))
    kept = vectors.where((F.size(x) == components) & whole)
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * SCALE).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, salt: str = "3:") -> np.ndarray:
    """The k vectors whose salted ids have the smallest hashes."""
    named = vectors.withColumn("h", F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256))
    rows = named.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), len(rows[0].v) if rows else 0)


def bisectors(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normals and thresholds of all pairs, by (smaller number, larger number)."""
    size = (centroids * centroids).sum(1)
    return 2 * (centroids[None] - centroids[:, None]), size[None] - size[:, None]


def nearest(x: np.ndarray, normals: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of each row of x; the champion always has a smaller number than its challenger."""
    champion = np.zeros(len(x), np.int64)
    for challenger in range(1, len(normals)):
        for c in range(challenger):
            rows = np.flatnonzero(champion == c)
            if len(rows):
                champion[rows[x[rows] @ normals[c, challenger] > thresholds[c, challenger]]] = challenger
    return champion


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def next_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the componentwise means of each centroid's vectors; an empty centroid stays."""
    k, width = centroids.shape
    normals, thresholds = bisectors(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                near = nearest(x, normals, thresholds)
                counts += np.bincount(near, minlength=k)
                np.add.at(sums, near, x)
        used = np.flatnonzero(counts)
        columns = [pa.array(used), pa.array(counts[used]), *(pa.array(s) for s in sums[used].T)]
        yield pa.record_batch(columns, names=names)

    names = ["cluster", "n", *(f"s{i}" for i in range(width))]
    partial = vectors.select("v").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    # A corpus of any size: sums of sums may pass a long, so they are added as decimals.
    total = partial.groupBy("cluster").agg(F.sum("n"), *(F.sum(F.col(c).cast("decimal(20,0)")) for c in names[2:]))
    out = centroids.copy()
    for cluster, n, *s in total.collect():
        out[cluster] = [int(x) // n for x in s]
    return out


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id``, ``cluster`` and ``distance`` (squared) of every vector."""
    normals, thresholds = bisectors(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            near = nearest(x, normals, thresholds) if len(x) else np.zeros(0, np.int64)
            away = x.reshape(len(near), -1) - centroids[near]
            yield pa.record_batch(
                [batch.column(0), pa.array(near.astype(np.int32)), pa.array((away * away).sum(1))], names=["vec_id", "cluster", "distance"]
            )

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster int, distance long")


def fingerprint(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS) -> DataFrame:
    """Every kept vector with its cluster, its squared distance, sums of distances, and the final centroid with its hash."""
    spark = vectors.sparkSession
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string"
    kept = durable(quantize(vectors, components))
    centroids = first_centroids(kept, k)
    if not len(centroids):
        return spark.createDataFrame([], result)
    for _ in range(rounds):
        centroids = next_centroids(kept, centroids)
    assigned = durable(assign(kept, centroids))
    sums = {r.cluster: r.d for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    inertia = sum(sums.values())
    about = [(c, sums.get(c, 0), inertia, row.tolist(), fingerprint(row)) for c, row in enumerate(centroids)]
    clusters = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    # k rows, a bound that no corpus moves.
    return assigned.join(F.broadcast(clusters), "cluster").select(*(c.split()[0] for c in result.split(", ")))
