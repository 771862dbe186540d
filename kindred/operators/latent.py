"""Latent semantic vectors: truncated SVD of the term matrix.

The term matrix A has one row per song and as many columns as the vocabulary
has terms (10,000 at most).  A block Krylov method with thick restarts runs on
the short side: each pass computes A'(AQ) for a narrow vocabulary x block
matrix Q, a few megabytes whatever the number of songs, and widens the basis
by what is new in it.  Passes end when the residual of every wanted component
is small, so their number follows the spectrum.  Tasks add up their share over
all their rows and the shares are summed by a shuffle on the vocabulary row, so
only Q itself reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.sources.shared import save_stage

COMPONENTS = 100
#: Largest |A'Av - s^2 v| / s^2 of a component, and passes after which the fit is given up.
TOLERANCE = 0.01
MOST_PASSES = 200
LEAST_BLOCK = 16
#: Songs that are multiplied at a time.
CHUNK_ROWS = 256
BLOCK_TERMS = 128


@dataclass
class LatentModel:
    """``vectors``: song_id, seq, vector (unit length, one entry per topic);
    ``scores``: the same before normalisation; ``components``: topic, term_id,
    loading; ``singular_values``: one per topic; ``residuals``: component, sigma, residual, orthogonality."""

    vectors: DataFrame
    scores: DataFrame
    components: DataFrame
    singular_values: np.ndarray
    right: np.ndarray
    residuals: DataFrame
    passes: int


def _gram_pass(vectors: DataFrame, q: np.ndarray) -> np.ndarray:
    """A'(AQ), summed over all tasks.

    A share is cut into blocks of vocabulary rows, and a block's shares are
    added one by one as they arrive, whatever the number of tasks.
    """
    summed = (
        vectors.select("term_ids", "weights")
        .mapInArrow(_gram_share(q, CHUNK_ROWS, BLOCK_TERMS), "block int, share array<double>")
        .groupBy("block")
        .agg(vector_to_array(Summarizer.sum(array_to_vector("share"))).alias("rows"))
    )
    out = np.zeros_like(q)
    # One row per block of the vocabulary comes back: Q's own size.
    table = summed.toArrow()
    for block, rows in zip(table.column("block").to_pylist(), table.column("rows").combine_chunks()):
        part = rows.values.to_numpy().reshape(-1, q.shape[1])
        out[block * BLOCK_TERMS : block * BLOCK_TERMS + len(part)] = part
    return out


def _gram_share(q: np.ndarray, chunk_rows: int, block_terms: int):
    """One task's A'(AQ) over its songs, some hundred at a time as a dense matrix."""

    def share(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros_like(q)
        buffer = np.zeros((chunk_rows, len(q)))
        for batch in batches:
            for at in range(0, batch.num_rows, chunk_rows):
                part = batch.slice(at, chunk_rows)
                row = np.repeat(np.arange(part.num_rows), np.diff(part.column("term_ids").offsets.to_numpy()))
                term = part.column("term_ids").flatten().to_numpy()
                buffer[row, term] = part.column("weights").flatten().to_numpy()
                songs = buffer[: part.num_rows]
                total += songs.T @ (songs @ q)
                buffer[row, term] = 0
        for block, start in enumerate(range(0, len(total), block_terms)):
            flat = pa.array(total[start : start + block_terms].ravel())
            ends = pa.array([0, len(flat)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.ListArray.from_arrays(ends, flat)], ["block", "share"]
            )

    return share


def _projector(right: np.ndarray, chunk_rows: int):
    """Scores of each song on the components: A V."""

    def project(batches):
        import numpy as np
        import pyarrow as pa

        k = right.shape[1]
        buffer = np.zeros((chunk_rows, len(right)))
        for batch in batches:
            scores = np.zeros((batch.num_rows, k))
            for at in range(0, batch.num_rows, chunk_rows):
                part = batch.slice(at, chunk_rows)
                row = np.repeat(np.arange(part.num_rows), np.diff(part.column("term_ids").offsets.to_numpy()))
                term = part.column("term_ids").flatten().to_numpy()
                buffer[row, term] = part.column("weights").flatten().to_numpy()
                scores[at : at + part.num_rows] = buffer[: part.num_rows] @ right
                buffer[row, term] = 0
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(batch.num_rows + 1) * k, pa.int32()), pa.array(scores.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("song_id"), batch.column("seq"), lists], ["song_id", "seq", "vector"]
            )

    return project


def unit_vectors(scores: DataFrame, dims: int | None = None) -> DataFrame:
    """Rows scaled to length one, a zero row stays zero; ``dims`` keeps the first entries."""
    cut = scores if dims is None else scores.withColumn("vector", F.slice("vector", 1, dims))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x))
    cut = cut.withColumn("_norm", norm)
    return cut.withColumn(
        "vector", F.when(F.col("_norm") > 0, F.transform("vector", lambda x: x / F.col("_norm"))).otherwise(F.col("vector"))
    ).drop("_norm")


def project_songs(vectors: DataFrame, right: np.ndarray) -> DataFrame:
    """``song_id, seq, vector``: the score of each song on given components (terms x components)."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return vectors.select("song_id", "seq", "term_ids", "weights").mapInArrow(
        _projector(right, CHUNK_ROWS), f"song_id {kinds['song_id']}, seq {kinds['seq']}, vector array<double>"
    )


def component_table(spark: SparkSession, right: np.ndarray) -> DataFrame:
    """``topic, term_id, loading`` of given components."""
    width, k = right.shape
    ends = pa.array(np.arange(width + 1) * k, pa.int32())
    loadings = spark.createDataFrame(
        pa.table(
            {
                "term_id": pa.array(np.arange(width), pa.int32()),
                "row": pa.ListArray.from_arrays(ends, pa.array(right.ravel())),
            }
        )
    )
    return loadings.select("term_id", F.posexplode("row").alias("_pos", "loading")).select(
        (F.col("_pos") + 1).alias("topic"), "term_id", "loading"
    )


def _fresh(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what is in ``block`` and not in ``basis``; it may have fewer columns."""
    scale = np.linalg.norm(block)
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    left, sizes, _ = np.linalg.svd(block, full_matrices=False)
    left = left[:, sizes > 1e-10 * max(scale, 1e-300)]
    # Rounding leaves traces of the basis in small columns.
    return np.linalg.qr(left - basis @ (basis.T @ left))[0] if left.shape[1] else left


def _leading(gram_pass, width: int, k: int, tolerance: float, seed: int):
    """The k leading eigenpairs of ``gram_pass``'s matrix: values, vectors, residuals and passes."""
    block = min(width, max(LEAST_BLOCK, -(-k // 3)))
    fresh = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, block)))[0]
    basis, image, small = fresh[:, :0], fresh[:, :0], np.zeros((0, 0))
    for passes in range(1, MOST_PASSES + 1):
        found = gram_pass(fresh)
        basis, image = np.hstack([basis, fresh]), np.hstack([image, found])
        cross, old = basis.T @ found, len(small)
        small = np.block([[small, cross[:old]], [cross[:old].T, (cross[old:] + cross[old:].T) / 2]])
        if len(small) < k and (more := _fresh(found, basis)).shape[1]:
            fresh = more
            continue
        values, turn = np.linalg.eigh(small)
        order = np.argsort(-values)
        values, turn = values[order], turn[:, order]
        best = basis @ turn[:, :k]
        residual = np.linalg.norm(image @ turn[:, :k] - best * values[:k], axis=0)
        fresh = _fresh(found, basis)
        floor = np.maximum(values[:k], 1e-12 * max(values[0], 1e-300))
        if basis.shape[1] >= k and ((residual <= tolerance * floor).all() or not fresh.shape[1]):
            return values[:k], best, residual / floor, passes
        if not fresh.shape[1]:  # the start lay in too small a space that the matrix does not leave
            fresh = _fresh(np.random.default_rng(seed + passes).normal(size=(width, block)), basis)
        if basis.shape[1] > 4 * (k + block):  # go on from the best directions alone
            kept = turn[:, : 2 * k + block]
            basis, image, small = basis @ kept, image @ kept, np.diag(values[: kept.shape[1]])
    raise RuntimeError(f"no convergence in {MOST_PASSES} passes")


def fit_latent(
    vectors: DataFrame,
    *,
    n_components: int = COMPONENTS,
    tolerance: float = TOLERANCE,
    seed: int = 42,
) -> LatentModel:
    """Truncated SVD of a saved term-vector table, not centred.

    A component's sign is fixed so that its loading of largest magnitude is
    positive.  ``n_components`` must not exceed the songs or the vocabulary.
    """
    spark = vectors.sparkSession
    size = vectors.agg(F.max(F.array_max("term_ids")), F.count(F.lit(1))).first()
    width = (size[0] if size[0] is not None else -1) + 1
    if n_components > min(width, size[1]):
        raise ValueError(f"n_components={n_components} exceeds {min(width, size[1])}")
    # A task sums all its rows before it sends its share, so a pass moves one share per core, however large the table.
    packed = vectors.coalesce(spark.sparkContext.defaultParallelism)
    values, right, residual, passes = _leading(lambda q: _gram_pass(packed, q), width, n_components, tolerance, seed)
    peak = right[np.abs(right).argmax(axis=0), np.arange(right.shape[1])]
    right = right * np.where(peak < 0, -1.0, 1.0)
    sigma = np.sqrt(np.maximum(values, 0))
    apart = np.abs(right.T @ right - np.eye(n_components)).max(axis=1)
    told = [(i + 1, *map(float, row)) for i, row in enumerate(zip(sigma, residual, apart, strict=True))]

    scores = save_stage(project_songs(vectors, right), "latent-scores")
    return LatentModel(
        vectors=unit_vectors(scores),
        scores=scores,
        components=component_table(spark, right),
        singular_values=sigma,
        right=right,
        residuals=spark.createDataFrame(told, "component int, sigma double, residual double, orthogonality double"),
        passes=passes,
    )


def explained_variance(scores: DataFrame, term_vectors: DataFrame) -> DataFrame:
    """``component, ratio, cumulative``: variance of each score over that of all terms.

    Population variance of the projected columns, before rows are normalised.
    """
    n = F.col("_n")
    moments = scores.agg(
        F.count(F.lit(1)).alias("_n"),
        vector_to_array(Summarizer.variance(array_to_vector("vector"))).alias("_var"),
    )
    per = moments.select(F.posexplode("_var").alias("_pos", "_v"), n).select(
        (F.col("_pos") + 1).alias("component"), (F.col("_v") * (n - 1) / n).alias("_var")
    )
    by_term = (
        term_vectors.select(F.inline(F.arrays_zip(F.col("term_ids").alias("t"), F.col("weights").alias("w"))))
        .groupBy("t")
        .agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("ss"))
    )
    rows = term_vectors.agg(F.count(F.lit(1)).cast("double")).scalar()
    total = by_term.agg(F.sum(F.col("ss") / rows - (F.col("s") / rows) * (F.col("s") / rows))).scalar()
    # One row per component, so the running sum needs no partition.
    running = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ratio = per.select("component", (F.col("_var") / total).alias("ratio"))
    return ratio.withColumn("cumulative", F.sum("ratio").over(running))


def components_needed(variance: DataFrame, thresholds=(0.3, 0.5, 0.7)) -> DataFrame:
    """First component count that reaches each share; NULL when none does."""
    wanted = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    return (
        variance.withColumn("threshold", wanted)
        .groupBy("threshold")
        .agg(F.min(F.when(F.col("cumulative") >= F.col("threshold"), F.col("component"))).alias("components"))
    )


def topic_terms(components: DataFrame, vocabulary: DataFrame, *, n_topics: int = 10, n_terms: int = 10) -> DataFrame:
    """Terms with the highest signed loading in each of the first topics.

    Terms that always occur together have one loading but for rounding, so ties are told at nine places.
    """
    named = components.where(F.col("topic") <= n_topics).join(vocabulary.select("term_id", "term"), "term_id")
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.round("loading", 9).desc(), "term"))
    return named.withColumn("rank", rank).where(F.col("rank") <= n_terms).select("topic", "rank", "term", "loading")


def song_topics(vectors: DataFrame, n_topics: int = 5) -> DataFrame:
    """Topics with the largest absolute score of each song; the score keeps its sign."""
    keyed = F.transform(
        "vector",
        lambda x, i: F.struct((-F.abs(x)).alias("o"), (i + 1).alias("topic"), F.round(x, 4).alias("score")),
    )
    best = vectors.select("song_id", F.posexplode(F.slice(F.sort_array(keyed), 1, n_topics)).alias("_i", "_t"))
    return best.select("song_id", (F.col("_i") + 1).alias("rank"), "_t.topic", "_t.score")
