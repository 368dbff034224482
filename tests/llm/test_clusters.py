"""Centroid clustering against a plain version."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import bisectors, queries


def plain(vectors, k=8, rounds=10):
    kept = []
    for i, v, *_ in vectors:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))

    def start(row):
        return (row[0] is None, hashlib.sha256(f"3:{row[0]}".encode()).hexdigest(), row[1])

    centroids = [v for _, v in sorted(kept, key=start)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, g in groups.items():
            centroids[n] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    placed = [(i, *nearest(v)) for i, v in kept]
    inner = {}
    for _, d, n in placed:
        inner[n] = inner.get(n, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, inner[n], sum(inner.values()), sha[n]) for i, d, n in placed), key=repr)


def vectors(seed):
    rng = random.Random(seed)

    def around(c):
        return [c + rng.gauss(0, 0.2) for _ in range(64)]

    rows = [(i, around(rng.choice([-0.5, 0.0, 0.4])), 1) for i in range(60)]
    rows += [(100 + i, rows[3][1], None) for i in range(40)]  # equal vectors
    rows += [(7, rows[7][1], 1), (7, around(2.0), 1)]  # an id twice
    odd = around(0.0)
    rows += [(200, None, 1), (201, [], 1), (202, odd[:63], 1), (203, [*odd, 0.0], 1), (204, [None, *odd[1:]], 1)]
    rows += [(205, [float("nan"), *odd[1:]], 1), (206, [float("-inf"), *odd[1:]], 1), (None, odd, None), (207, [1000.5, *odd[1:]], 1)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters(spark, folder, seed):
    rows = vectors(seed)
    got = queries.op11_centroid_clustering(spark, folder(extra=True, embeddings=rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)


def test_few_and_no_vectors(spark, folder):
    assert queries.op11_centroid_clustering(spark, folder()).count() == 0
    few = [(i, [float(i)] * 64, 1) for i in (1, 2, 2)]
    got = queries.op11_centroid_clustering(spark, folder(embeddings=few)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(few)
    no_ids = [(None, [float(i)] * 64, 1) for i in range(3)]
    assert queries.op11_centroid_clustering(spark, folder(embeddings=no_ids)).count() == 3


def test_ties_favour_the_smaller_number():
    centroids = np.array([[0, 0], [4, 0], [4, 0], [0, 4]], np.int64)
    x = np.array([[2, 0], [4, 0], [0, 2], [2, 2], [5, 1]], np.int64)
    assert bisectors.nearest(x, *bisectors.bisectors(centroids)).tolist() == [0, 1, 0, 0, 1]


def test_sizes_beyond_a_long_are_left_out(spark):
    df = spark.createDataFrame([(1, [3e38] * 64), (2, [1.0] * 64)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in bisectors.cluster(df.withColumn("v", F.lit(1))).collect()] == [2]
