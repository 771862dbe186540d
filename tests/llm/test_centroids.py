import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("kindred.llm")
from pyspark.errors import PySparkException  # noqa: E402

from kindred.llm import centroids  # noqa: E402


def plain(vectors, k, rounds):
    """Assignment and centroids by whole distances; ``vectors`` holds (id, integer components)."""
    order = sorted(vectors, key=lambda v: (hashlib.sha256(f"1:{v[0]}".encode()).hexdigest(), v[1]))
    found = [list(v[1]) for v in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(found))
    for _ in range(rounds):
        at = [near(x)[1] for _, x in vectors]
        for i in range(len(found)):
            if own := [x for (_, x), a in zip(vectors, at, strict=True) if a == i]:
                found[i] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return sorted((v, *reversed(near(x))) for v, x in vectors), found


def made(spark, rows, width, k, rounds):
    df = spark.createDataFrame([(v, x, "c", 1) for v, x in rows], "vec_id long, embedding array<float>, cluster string, x int").repartition(4)
    state, found = centroids.cluster(centroids.integers(df, width=width), k=k, rounds=rounds)
    return state, found


@pytest.mark.parametrize("rounds", [0, 1, 5])
def test_incremental_distances_equal_whole_ones(spark, rounds):
    rng = random.Random(rounds)
    rows = [(i, [rng.gauss(0, 1 if i % 3 else 40) for _ in range(5)]) for i in range(400)]
    rows += [(1000 + i, [0.5, -0.25, 0.0, 1.0, -1.0]) for i in range(200)]  # a large group of equal vectors
    rows += [(7, [0.5, -0.25, 0.0, 1.0, -1.0])]
    state, found = made(spark, rows, 5, 6, rounds)
    ints = [(v, [int(np.floor(64 * float(np.float32(c)))) for c in x]) for v, x in rows]
    want, centers = plain(ints, 6, rounds)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in state.collect()) == want
    assert found.tolist() == centers
    for r in state.limit(50).collect():
        assert r.dots == [sum(a * b for a, b in zip(r.x, c, strict=True)) for c in centers]


def test_unusable_vectors_are_left_out_and_few_vectors_make_few_clusters(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1.0, -inf]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [-1.0, -2.0])]
    state, found = made(spark, rows, 2, 16, 3)
    assert sorted((r.vec_id, r.distance) for r in state.collect()) == [(1, 0), (9, 0)] and len(found) == 2
    told = {r.cluster: r for r in centroids.summary(state, found).collect()}
    assert len(told) == 2 and all(r.inertia == 0 for r in told.values())


def test_repeated_ids_and_rows_and_an_empty_centroid(spark):
    rows = [(1, [1.0]), (1, [1.0]), (1, [1.0]), (1, [2.0])]
    state, found = made(spark, rows, 1, 3, 2)
    got = sorted((r.x[0], r.cluster, r.distance) for r in state.collect())
    # all three start equal, so the first takes every row and moves; its copies then win the rows it left
    assert got == [(64, 1, 0)] * 3 + [(128, 0, 0)]
    assert found.tolist() == [[128], [64], [64]]


def test_empty_table_and_too_large_components(spark):
    state, found = made(spark, [(1, None)], 2, 4, 3)
    assert state.count() == 0 and len(found) == 0 and centroids.summary(state, found).count() == 0
    with pytest.raises(PySparkException):
        made(spark, [(1, [1e30, 0.0])], 2, 4, 1)


def test_large_exact_products(spark):
    rows = [(i, [2_000_000.0 * (-1) ** i, 1_999_999.0, float(i)]) for i in range(20)]
    state, found = made(spark, rows, 3, 4, 2)
    ints = [(v, [int(np.floor(64 * float(np.float32(c)))) for c in x]) for v, x in rows]
    want, centers = plain(ints, 4, 2)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in state.collect()) == want and found.tolist() == centers
