"""Centroid clustering over integers with an incremental distance matrix.

Every vector keeps its exact dot product with each centroid.  A round looks only at the components of a
centroid that changed: their change times the vector's component is added to the stored product, and the
nearest centroid follows from products and norms.  Products start at zero against centroids of zeros, so
the first round is an update like any other.  Vectors never move: a task updates the rows it reads and
writes them for the next round, and what leaves a task is one row of sums per centroid.

Defined results: only vectors of the asked width without null, NaN or infinite components are kept, each
row by itself even if its id repeats or is null (a null id is hashed as ``-``); equal hashes go by the
components; with fewer vectors than centroids there are as many centroids as vectors; an empty table
gives an empty result.  Other columns are not read.  A component of LIMIT or more after scaling is an
error, since squared distances of 64 such components no longer fit 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.sources.shared import save_stage

WIDTH = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
LIMIT = 1 << 27
#: Sums of products below this are exact in floating point, in any order.
EXACT = 1 << 53


def integers(df: DataFrame, key: str = "vec_id", vector: str = "embedding", *, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """``key`` and ``x``: every usable vector as ``floor(scale * component)``."""
    v = F.col(vector)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform(v, lambda c: F.floor(c.cast("double") * scale))
    large = F.exists(v, lambda c: F.abs(c.cast("double")) * scale >= LIMIT)
    checked = F.when(large, F.raise_error(F.lit(f"a component of {LIMIT} or more"))).otherwise(scaled.cast("array<int>"))
    return df.select(key, vector).where((F.size(v) == width) & finite).select(F.col(key), checked.alias("x"))


def first_centroids(vectors: DataFrame, key: str, k: int, seed: int = 1) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest hashes, in order of these."""
    mixed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("-"))), 256)
    rows = vectors.orderBy(mixed, "x").limit(k).select("x").collect()  # k rows
    return np.array([r.x for r in rows], np.int64)


def _updater(key: str, old: np.ndarray, new: np.ndarray):
    """Adds to the products what the changed components of each centroid make of them, then assigns."""
    change = new - old
    touched = [(k, np.flatnonzero(line)) for k, line in enumerate(change) if line.any()]
    norms = (new * new).sum(axis=1)

    def update(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cells = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            x = cells.astype(np.int64).reshape(n, -1)
            if "dots" in batch.schema.names:
                dots = batch.column("dots").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)
            else:
                dots = np.zeros((n, len(new)), np.int64)
            small = int(np.abs(x).max(initial=0)) * int(np.abs(change).max(initial=0)) * x.shape[1] < EXACT
            reals = x.astype(np.float64) if small else None
            for k, at in touched:
                dots[:, k] += (reals[:, at] @ change[k, at].astype(np.float64)).astype(np.int64) if small else x[:, at] @ change[k, at]
            distance = (x * x).sum(axis=1)[:, None] - 2 * dots + norms
            nearest = distance.argmin(axis=1)
            ends = pa.array(np.arange(0, dots.size + 1, dots.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    batch.column("x"),
                    pa.ListArray.from_arrays(ends, pa.array(dots.ravel())),
                    pa.array(nearest.astype(np.int32)),
                    pa.array(distance[np.arange(n), nearest]),
                ],
                [key, "x", "dots", "cluster", "distance"],
            )

    return update


def _recentred(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floor of the mean of each cluster's vectors; an empty cluster keeps its centroid."""
    sums = [F.sum(F.col("x")[j].cast("bigint")).alias(f"s{j}") for j in range(centroids.shape[1])]
    moved = centroids.copy()
    for row in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # a row a centroid
        moved[row.cluster] = [row[f"s{j}"] // row.n for j in range(centroids.shape[1])]
    return moved


def cluster(vectors: DataFrame, key: str = "vec_id", *, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """``key, x, dots, cluster, distance`` of every vector after ``rounds`` moves, and the centroids.

    Rounds after the last change would repeat the same result and are left out.
    """
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, x array<int>, dots array<bigint>, cluster int, distance bigint"
    centroids = first_centroids(vectors, key, k, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema), centroids
    old = np.zeros_like(centroids)
    state = save_stage(vectors.mapInArrow(_updater(key, old, centroids), schema), "centroid-round")
    for _ in range(rounds):
        old, centroids = centroids, _recentred(state, centroids)
        if (old == centroids).all():
            break
        state = save_stage(state.mapInArrow(_updater(key, old, centroids), schema), "centroid-round")
    return state, centroids


def summary(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``cluster, cluster_inertia, inertia, centroid_sha256``: a row for each centroid that has vectors."""
    sums = state.groupBy("cluster").agg(F.sum("distance").alias("own")).collect()  # a row a centroid
    whole = sum(r.own for r in sums)
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    rows = [(r.cluster, r.own, whole, digest(centroids[r.cluster])) for r in sums]
    return state.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
