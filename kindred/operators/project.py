"""Two-dimensional projection of dense vectors, and pooling of token vectors."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance (divided by n - 1) of the ``vector`` column.

    The first pass takes the mean and the second adds up products of what is left, so large means cost
    no digits.  A task sends one row per dimension; the driver gets a matrix of dimensions by dimensions.
    """
    x = array_to_vector(F.col("vector").cast("array<double>"))
    n, mean = vectors.agg(F.count("vector"), Summarizer.mean(x)).first()
    if not n:
        raise ValueError("no vectors")
    mean = mean.toArray()
    rows = (
        vectors.select("vector")
        .mapInArrow(_products(mean), "dim int, products array<double>")
        .groupBy("dim")
        .agg(vector_to_array(Summarizer.sum(array_to_vector("products"))).alias("products"))
    )
    total = np.zeros((len(mean), len(mean)))
    for row in rows.collect():  # a row per dimension
        total[row.dim] = row.products
    return n, mean, total / max(n - 1, 1)


def _products(mean: np.ndarray):
    def share(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((len(mean), len(mean)))
        for batch in batches:
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, len(mean)) - mean
            total += x.T @ x
        ends = pa.array(np.arange(len(mean) + 1) * len(mean), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(mean)), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(total.ravel()))], ["dim", "products"]
        )

    return share


def principal_axes(vectors: DataFrame, k: int = 2) -> tuple[DataFrame, list[float]]:
    """Centred projection on the first k axes and each axis' share of variance.

    Returns ``song_id, pc1..pck`` and the ratios.  An axis points so that its
    loading of largest magnitude is positive.
    """
    _, mean, covariance = moments(vectors)
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:k]
    axes = axes[:, order]
    peak = axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])]
    axes = axes * np.where(peak < 0, -1.0, 1.0)
    centred = F.zip_with(F.col("vector").cast("array<double>"), F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x - m)

    def along(axis):
        loadings = F.array(*[F.lit(float(a)) for a in axis])
        return F.aggregate(F.zip_with("_x", loadings, lambda x, a: x * a), F.lit(0.0), lambda s, v: s + v)

    coords = [along(axes[:, i]).alias(f"pc{i + 1}") for i in range(axes.shape[1])]
    total = values.sum()
    ratios = [float(values[i] / total) if total > 0 else 0.0 for i in order]
    return vectors.select("song_id", centred.alias("_x")).select("song_id", *coords), ratios


def mean_pool(token_vectors: DataFrame, key: str = "song_id") -> DataFrame:
    """Masked mean of ``key, vector, mask`` rows: one vector per key.

    The divisor never falls below 1e-9, so a key whose tokens are all masked
    gets a zero vector.  Sums are built per task before the shuffle.
    """
    masked = F.transform(F.col("vector").cast("array<double>"), lambda x: x * F.col("mask"))
    sums = token_vectors.groupBy(key).agg(
        vector_to_array(Summarizer.sum(array_to_vector(masked))).alias("_sum"),
        F.sum(F.col("mask").cast("double")).alias("_n"),
    )
    return sums.select(key, F.transform("_sum", lambda x: x / F.greatest("_n", F.lit(1e-9))).alias("vector"))
