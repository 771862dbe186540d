"""Similarity operators against brute force on small fixtures."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.operators import matrices, neighbours, pairs, terms, topk
from kindred.sources.shared import save_stage


def make_songs(n=60, copies=20, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(80)]
    texts = [[rng.choice(words[: rng.choice([10, 80])]) for _ in range(rng.randint(3, 40))] for _ in range(n)]
    texts += [texts[5]] * copies  # one hot group of copies
    texts += [texts[5][:-1] + ["x"]] * 3
    texts += [["solo"], ["a", "b"], []]  # no vocabulary term at all
    return [(i, i, t) for i, t in enumerate(texts)]


def brute_vectors(songs, max_features=10_000, min_df=2):
    grams = {}
    for sid, _, toks in songs:
        w = [t for t in toks if len(t) >= 2]
        grams[sid] = Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    cf, df = Counter(), Counter()
    for c in grams.values():
        cf.update(c)
        df.update(c.keys())
    vocab = sorted((t for t in cf if df[t] >= min_df), key=lambda t: (-cf[t], t))[:max_features]
    vocab.sort()
    idf = {t: math.log((1 + len(songs)) / (1 + df[t])) + 1 for t in vocab}
    x = np.array([[grams[s[0]][t] * idf[t] for t in vocab] for s in songs])
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return vocab, idf, np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


@pytest.fixture(scope="module")
def fitted(spark):
    songs = make_songs()
    df = save_stage(spark.createDataFrame(songs, "song_id long, seq long, tokens array<string>").repartition(5), "t")
    vocab = save_stage(terms.fit_vocabulary(df), "tv")
    vectors = save_stage(terms.term_vectors(df, vocab), "tx")
    names, idf, x = brute_vectors(songs)
    return songs, df, vocab, vectors, names, idf, x


def brute_top(x, seed, k):
    sims = np.round(x @ x[seed], 6)
    order = sorted((i for i in range(len(x)) if i != seed), key=lambda i: (-sims[i], i))[:k]
    return [(i, pytest.approx(sims[i], abs=2e-6)) for i in order]


def test_vocabulary_and_weights(fitted, spark):
    songs, df, vocab, vectors, names, idf, x = fitted
    rows = vocab.orderBy("term_id").collect()
    assert [r["term"] for r in rows] == names
    assert [r["idf"] for r in rows] == pytest.approx([idf[t] for t in names])
    for r in vectors.collect():
        dense = np.zeros(len(names))
        dense[r["term_ids"]] = r["weights"]
        assert dense == pytest.approx(x[r["song_id"]])
    assert vectors.count() == len(songs)


@pytest.mark.parametrize("features", [7, 60, 90, 300])
@pytest.mark.parametrize("small", [True, False])
def test_vocabulary_cut_breaks_ties_by_term(fitted, monkeypatch, features, small):
    songs, df, *_ = fitted
    if not small:
        monkeypatch.setattr(terms, "BROADCAST_TERMS", 0)
    names, _, _ = brute_vectors(songs, max_features=features)
    got = [r["term"] for r in terms.fit_vocabulary(df, max_features=features).orderBy("term_id").collect()]
    assert got == names


def test_term_vector_plan_has_one_shuffle(fitted):
    _, df, vocab, *_ = fitted
    plan = terms.term_vectors(df, vocab)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_terms_are_counted_as_arrays(fitted, monkeypatch):
    """No occurrence of a term becomes a row: a task sends one row per term and piece of songs."""
    songs, df, vocab, *_ = fitted
    assert "explode" not in terms.term_vectors(df, vocab)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(terms, "PIECE_ROWS", len(songs))
    sent = df.select("tokens").coalesce(1).mapInArrow(terms._count_words, "term string, _all long, _doc long").collect()
    words = [[w for w in t if len(w) >= 2] for _, _, t in songs]
    assert len(sent) == len({w for t in words for w in t})
    assert {r["term"]: (r["_all"], r["_doc"]) for r in sent} == {
        w: (sum(t.count(w) for t in words), sum(w in t for t in words)) for t in words for w in t
    }


def test_vectors_of_odd_rows_are_those_of_a_join(spark, monkeypatch):
    """Words with blanks, missing words and lists, repeated and missing keys, a term that stands twice."""
    rows = [
        (1, 1, ["aa", "bb", "aa bb", "cc", None, "", "é", "ßß"]), (1, 1, ["aa", "bb"]), (1, 2, ["aa bb", "cc"]), (2, 2, None),
        (3, 3, []), (4, 4, ["zz"]), (None, None, ["aa", "bb", "cc"]), (None, None, ["bb cc", "aa"]), (5, 5, ["aa", "x", "bb", "cc"]),
    ]
    songs = spark.createDataFrame(rows, "song_id long, seq long, tokens array<string>")
    listed = [("aa", 0, 1.5), ("aa bb", 1, 2.0), ("aa bb", 5, 3.0), ("aa bb cc", 2, 2.5), ("bb cc", 3, 1.25), ("ßß", 4, 1.0), (None, 6, 1.0)]
    vocabulary = spark.createDataFrame(listed, "term string, term_id int, idf double")

    def told(**options):
        found = terms.term_vectors(songs, vocabulary, **options).collect()
        return sorted(((str(r[0]), str(r[1]), r[2], [round(w, 9) for w in r[3]]) for r in found), key=repr)

    here = told(), told(use_idf=False)
    fitted = [tuple(r) for r in terms.frequent_terms(songs, min_df=1).orderBy("term").collect()]
    monkeypatch.setattr(terms, "PIECE_ROWS", 1)
    assert (told(), told(use_idf=False)) == here
    monkeypatch.setattr(terms, "BROADCAST_TERMS", 0)
    assert (told(), told(use_idf=False)) == here
    assert [tuple(r) for r in terms.frequent_terms(songs, min_df=1).orderBy("term").collect()] == fitted
    assert {("aa bb", 2, 2), ("aa bb", 4, 4), ("aa bb cc", 2, 2)} <= set(fitted)


@pytest.mark.parametrize("way", ["scan", "cells"])
def test_top_k_sparse(fitted, spark, monkeypatch, way):
    *_, vectors, names, idf, x = fitted
    monkeypatch.setattr(topk, "CHUNK_ROWS", 7)
    if way != "scan":
        monkeypatch.setattr(topk, "SCAN_SEEDS", 0)
    wanted = [0, 5, 7, len(x) - 1, len(x) - 3]
    seeds = spark.createDataFrame([(f"s{i}", i) for i in wanted], "seed_id string, song_id long")
    got = topk.top_k(vectors, seeds, 12).orderBy("seed_id", "rank").collect()
    for i in wanted:
        mine = [(r["song_id"], r["similarity"]) for r in got if r["seed_id"] == f"s{i}"]
        assert mine == brute_top(x, i, 12)


def test_scan_moves_only_candidates(fitted, spark):
    *_, vectors, names, idf, x = fitted
    seeds = spark.createDataFrame([(0, 5)], "seed_id int, song_id long")
    plan = topk.top_k(vectors, seeds, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    limits = [i for i, line in enumerate(plan.splitlines()) if "WindowGroupLimit" in line]
    assert len(limits) == 2  # k rows per seed and task before the shuffle


def test_no_seed_gives_no_rows(fitted, spark):
    *_, vectors, names, idf, x = fitted
    assert topk.top_k(vectors, spark.createDataFrame([], "seed_id int, song_id long"), 3).count() == 0


def test_short_corpus_gives_fewer_rows(spark):
    df = spark.createDataFrame([(1, 1, [0], [1.0]), (2, 2, [0], [1.0]), (3, 3, [], [])],
                               "song_id long, seq long, term_ids array<int>, weights array<double>")
    seeds = spark.createDataFrame([("a", 1)], "seed_id string, song_id long")
    got = topk.top_k(df, seeds, 10).orderBy("rank").collect()
    assert [(r["rank"], r["song_id"], r["similarity"]) for r in got] == [(1, 2, 1.0), (2, 3, 0.0)]


@pytest.mark.parametrize("cell_rows", [7, 30, 1_000])
def test_all_neighbours_sparse(fitted, monkeypatch, cell_rows):
    monkeypatch.setattr(neighbours, "FAN", 4)
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", 10)
    monkeypatch.setattr(neighbours, "HOT_CLASS", 6)
    *_, vectors, names, idf, x = fitted
    got = neighbours.all_neighbours(vectors, 4, cell_rows=cell_rows).orderBy("seed_id", "rank").collect()
    for i in range(len(x)):
        assert [(r["song_id"], r["similarity"]) for r in got if r["seed_id"] == i] == brute_top(x, i, 4)


@pytest.fixture(scope="module")
def dense(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 6)).astype("float32")
    x[7] = 0
    x[8] = x[9]
    df = spark.createDataFrame([(i, i, [float(v) for v in r]) for i, r in enumerate(x)],
                               "song_id long, seq long, vector array<float>").repartition(4)
    y = x.astype("float64")
    norm = np.sqrt((y * y).sum(1, keepdims=True))
    return df, np.divide(y, norm, out=np.zeros_like(y), where=norm > 0)


@pytest.mark.parametrize("small", [True, False])
def test_top_k_dense(dense, spark, monkeypatch, small):
    df, x = dense
    if not small:
        monkeypatch.setattr(topk, "SCAN_SEEDS", 0)
    wanted = [3, 7, 8]
    seeds = spark.createDataFrame([(i, i) for i in wanted], "seed_id long, song_id long")
    got = topk.top_k(df, seeds, 6).orderBy("seed_id", "rank").collect()
    for i in wanted:
        assert [(r["song_id"], r["similarity"]) for r in got if r["seed_id"] == i] == brute_top(x, i, 6)


@pytest.mark.parametrize("cell_rows", [5, 20, 1_000])
def test_all_neighbours_dense(dense, monkeypatch, cell_rows):
    df, x = dense
    monkeypatch.setattr(neighbours, "FAN", 3)
    got = neighbours.all_neighbours(df, 3, cell_rows=cell_rows).orderBy("seed_id", "rank").collect()
    for i in range(len(x)):
        assert [(r["song_id"], r["similarity"]) for r in got if r["seed_id"] == i] == brute_top(x, i, 3)


def brute_pairs(x, k):
    sims = np.round(x @ x.T, 6)
    every = [(i, j) for i in range(len(x)) for j in range(i + 1, len(x))]
    every.sort(key=lambda p: (-sims[p], *p))
    return [(a, b, pytest.approx(sims[a, b], abs=2e-6)) for a, b in every[:k]]


@pytest.mark.parametrize("k, cell_rows", [(15, 1_000), (15, 7), (300, 1_000), (400, 12)])
def test_most_similar_pairs(fitted, monkeypatch, k, cell_rows):
    *_, vectors, names, idf, x = fitted
    monkeypatch.setattr(neighbours, "FAN", 6)
    got = pairs.most_similar_pairs(vectors, k, cell_rows=cell_rows).orderBy("rank").collect()
    assert [(r["song_a"], r["song_b"], r["similarity"]) for r in got] == brute_pairs(x, k)


def test_most_similar_pairs_of_dense_vectors(dense):
    df, x = dense
    got = pairs.most_similar_pairs(df, 20, cell_rows=6).orderBy("rank").collect()
    assert [(r["song_a"], r["song_b"], r["similarity"]) for r in got] == brute_pairs(x, 20)


def test_pairs_send_songs_into_few_cells(spark, monkeypatch):
    """Groups without shared terms and no near copies: less is sent than to every other cell."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(600):
        terms_of = sorted(rng.choice(40, 12, replace=False) + 40 * (i % 15))
        w = rng.random(12)
        rows.append((i, i, [int(t) for t in terms_of], [float(v) for v in w / np.sqrt((w * w).sum())]))
    df = save_stage(spark.createDataFrame(rows, "song_id long, seq long, term_ids array<int>, weights array<double>"), "groups")
    sent = []
    routed = neighbours.routed
    monkeypatch.setattr(neighbours, "routed", lambda *a: sent.append(routed(*a)) or sent[-1])
    got = pairs.most_similar_pairs(df, 10, cell_rows=30).orderBy("rank").collect()
    x = np.zeros((600, 600))
    for i, _, t, w in rows:
        x[i, t] = w
    assert [(r["song_a"], r["song_b"], r["similarity"]) for r in got] == brute_pairs(x, 10)
    cells = sent[0].select("_leaf").distinct().count()
    assert cells > 10 and sent[0].count() < 600 * cells / 4, (cells, sent[0].count())


def test_most_similar_pairs_fills_with_zero_pairs(spark):
    rows = [(i, i, [i], [1.0]) for i in range(5)] + [(5, 5, [0], [1.0])]
    df = spark.createDataFrame(rows, "song_id long, seq long, term_ids array<int>, weights array<double>")
    x = np.zeros((6, 5))
    for i, _, t, _ in rows:
        x[i, t] = 1
    got = pairs.most_similar_pairs(df, 4).orderBy("rank").collect()
    assert [(r["song_a"], r["song_b"], r["similarity"]) for r in got] == brute_pairs(x, 4)


def test_sample_pairs(fitted, dense):
    for vectors, x in [(fitted[3], fitted[6]), dense]:
        sample = pairs.sample_songs(vectors, 25)
        ids = sorted(r["song_id"] for r in sample.collect())
        got = {(r["song_a"], r["song_b"]): r["similarity"] for r in pairs.sample_pair_scores(sample).collect()}
        want = {(a, b): pytest.approx(float(x[a] @ x[b]), abs=2e-6) for a in ids for b in ids if a < b}
        assert got == want


def test_broken_vectors_are_told():
    import pyarrow as pa

    from kindred.operators.matrices import unit_matrix

    for rows in ([[1.0, 2.0], None], [[1.0, 2.0], [1.0]], [[1.0, None], [1.0, 2.0]], [[1.0, float("nan")], [1.0, 2.0]]):
        with pytest.raises(ValueError):
            unit_matrix()(pa.table({"vector": pa.array(rows, pa.list_(pa.float64()))}))


def test_best_columns_keep_every_number():
    import numpy as np

    from kindred.operators.matrices import best_columns

    assert best_columns(2)(np.array([0.5, np.nan, 0.3, np.nan, 0.2])).tolist() == [0, 2]


def test_halves_are_rounded_as_spark_does(spark):
    import numpy as np

    from kindred.operators.matrices import rounder

    values = [0.0078125, -0.0078125, 0.5, 1 / 3, 0.0]
    wanted = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").selectExpr("round(v, 6)").collect()]
    assert rounder(6)(np.array(values)).tolist() == wanted


def test_many_seeds_equal_one_scan(spark, monkeypatch):
    from kindred.operators import topk

    rows = [(k, k, [float((k * 7 + j * 3) % 11) - 5 for j in range(4)]) for k in range(40)]
    vectors = spark.createDataFrame(rows, "song_id long, seq long, vector array<double>")
    seeds = vectors.select(F.col("song_id").alias("seed_id"), "song_id")
    whole = sorted(map(tuple, topk.top_k(vectors, seeds, 3).collect()))
    monkeypatch.setattr(topk, "SCAN_SEEDS", 7)
    assert sorted(map(tuple, topk.top_k(vectors, seeds, 3).collect())) == whole


def clustered(spark, n, per_group=20, width=16):
    """Vectors in tight groups whose number grows with the table."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(n // per_group, width))
    x = np.repeat(centres, per_group, axis=0) + 0.02 * rng.normal(size=(n, width))
    df = spark.createDataFrame([(i, i, [float(v) for v in r]) for i, r in enumerate(x)], "song_id long, seq long, vector array<double>")
    return save_stage(df.repartition(4), "clustered"), x / np.sqrt((x * x).sum(1, keepdims=True))


def test_a_song_meets_only_cells_that_can_hold_a_neighbour(spark):
    """Of some twenty or some hundred cells a song enters a few, and the rest would not have changed its list."""
    copies = []
    for n in (800, 3200):
        df, x = clustered(spark, n)
        found, work = neighbours.search(df, 5, cell_rows=80)
        steps = {r["step"]: r for r in work.collect()}
        copies.append(steps["other cells"]["queries"] / n)
        pairs_met = sum(r["pairs"] for r in steps.values())
        assert pairs_met < 0.3 * n * n
        if n == 800:
            rows = found.orderBy("song_id", "rank").collect()
            for i in range(n):
                assert [(r["neighbour"], r["similarity"]) for r in rows if r["song_id"] == i] == brute_top(x, i, 5)
    assert max(copies) < 3, copies


def test_a_third_of_all_songs_with_one_vector(spark):
    rows = [(i, 1000 - i, [1, 2] if i % 3 == 0 else [i % 7 + 3, i % 11 + 20], [0.6, 0.8]) for i in range(300)]
    df = spark.createDataFrame(rows, "song_id long, seq long, term_ids array<int>, weights array<double>")
    vectors = save_stage(df.select("song_id", "seq", F.expr("cast(term_ids as array<int>)").alias("term_ids"), "weights"), "third")
    found, work = neighbours.search(vectors, 4, cell_rows=20)
    assert sum(r["queries"] for r in work.where("step = 'own cell'").collect()) == 1 + len({(i % 7, i % 11) for i in range(300) if i % 3})
    x = np.zeros((300, 40))
    for i, _, t, w in rows:
        x[i, t] = w
    sims, got = np.round(x @ x.T, 6), {}
    for r in found.collect():
        got.setdefault(r["song_id"], {})[r["rank"]] = (r["neighbour"], r["similarity"])
    for i in range(300):
        order = sorted((j for j in range(300) if j != i), key=lambda j: (-sims[i, j], -j))[:4]
        assert [got[i][k] for k in (1, 2, 3, 4)] == [(j, pytest.approx(sims[i, j], abs=2e-6)) for j in order]


def test_neighbours_of_nothing_and_of_one(spark):
    kind = "song_id long, seq long, vector array<double>"
    assert neighbours.all_neighbours(spark.createDataFrame([], kind), 3).count() == 0
    assert neighbours.all_neighbours(spark.createDataFrame([(1, 1, [1.0])], kind), 3).count() == 0


@pytest.mark.parametrize("dense_kind", [True, False])
def test_songs_are_sent_by_number_and_copied_once_a_block(spark, monkeypatch, dense_kind):
    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(size=(300, 6)))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    if dense_kind:
        rows, kind = [(i, i, [float(c) for c in v]) for i, v in enumerate(x)], "vector array<double>"
    else:
        rows, kind = [(i, i, list(range(6)), [float(c) for c in v]) for i, v in enumerate(x)], "term_ids array<int>, weights array<double>"
    df = save_stage(spark.createDataFrame(rows, f"song_id long, seq long, {kind}"), "unstructured")
    monkeypatch.setattr(neighbours, "FAN", 20)
    monkeypatch.setattr(neighbours, "BLOCK_CELLS", 8)
    sent, met = [], []
    routed, meetings = neighbours.routed, neighbours.meetings
    monkeypatch.setattr(neighbours, "routed", lambda *a: sent.append(routed(*a)) or sent[-1])
    monkeypatch.setattr(neighbours, "meetings", lambda *a: met.append(meetings(*a)) or met[-1])
    got = {(r["seed_id"], r["rank"]): r["song_id"] for r in neighbours.all_neighbours(df, 3, cell_rows=15).collect()}
    assert got == {(i, n + 1): j for i in range(300) for n, (j, _) in enumerate(brute_top(x, i, 3))}
    assert set(sent[0].columns) == {"_qid", "_own", "_block", "_leaf"}  # no vector
    copies, cells = sent[0].select("_qid", "_block").distinct().count(), sent[0].count()
    assert len(met) == 1 and copies < cells and sent[0].agg(F.countDistinct("_block")).first()[0] > 1


def test_where_most_blocks_are_met_vectors_are_not_copied(spark, monkeypatch):
    """Blocks meet in a cross join: behind it a query has its k + 1 best of a block, not of each leaf."""
    rng = np.random.default_rng(6)
    x = np.abs(rng.normal(size=(300, 6)))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    rows = [(i, i, list(range(6)), [float(c) for c in v]) for i, v in enumerate(x)]
    df = save_stage(spark.createDataFrame(rows, "song_id long, seq long, term_ids array<int>, weights array<double>"), "crossed")
    monkeypatch.setattr(neighbours, "FAN", 20)
    monkeypatch.setattr(neighbours, "BLOCK_CELLS", 8)
    met, meetings = [], neighbours.meetings
    monkeypatch.setattr(neighbours, "meetings", lambda *a: met.append(meetings(*a)) or met[-1])
    got = {(r["seed_id"], r["rank"]): r["song_id"] for r in neighbours.all_neighbours(df, 3, cell_rows=15).collect()}
    assert got == {(i, n + 1): j for i in range(300) for n, (j, _) in enumerate(brute_top(x, i, 3))}
    plan = met[0]._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "CartesianProduct" in line or "BroadcastNestedLoopJoin" in line]
    assert joins and "cogroup" not in plan.lower()
    # At most four blocks of some eight leaves.
    assert met[0].count() <= 300 * 4 * 4


@pytest.mark.parametrize("common", [2, 10**9])
def test_common_terms_do_not_change_scores(common, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.where(rng.random((50, 30)) < rng.random(30), rng.random((50, 30)), 0)
    ids = pa.array([np.flatnonzero(v).astype("int32") for v in x], pa.list_(pa.int32()))
    table = pa.table({"term_ids": ids, "weights": pa.array([v[v > 0] for v in x], pa.list_(pa.float64()))})
    monkeypatch.setattr(matrices, "COMMON_ROWS", common)
    right = np.arange(7, 50)
    for rows, sims in matrices.row_scorer(True, 6, 8)(table, np.arange(20), right):
        assert np.abs(sims - x[rows] @ x[right].T).max() < 1e-6


@pytest.mark.parametrize("common, scratch, most", [(2, 1, 3), (10**9, 1 << 22, 1 << 14)])
@pytest.mark.parametrize("keep, across", [(3, False), (3, True), (10**6, False)])
def test_single_precision_loses_no_pair(monkeypatch, common, scratch, most, keep, across):
    """Scores that single precision cannot tell apart: what reaches a floor is found, with its full score."""
    rng = np.random.default_rng(9)
    x = np.where(rng.random((60, 40)) < rng.random(40), rng.random((60, 40)), 0)
    x[:, 0] += 0.1
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    x[30:40] = x[10:20] + 1e-9 * rng.random((10, 40)) * (x[10:20] > 0)
    ids = pa.array([np.flatnonzero(v).astype("int32") + 10**6 for v in x], pa.list_(pa.int32()))
    table = pa.table({"term_ids": ids, "weights": pa.array([v[v > 0] for v in x], pa.list_(pa.float64()))})
    for name, value in (("COMMON_ROWS", common), ("SCRATCH", scratch), ("EXACT_PAIRS", most), ("FILTER_ROWS", 7)):
        monkeypatch.setattr(matrices, name, value)
    sims, left, right = x @ x.T, np.arange(20), np.arange(20, 60)
    floors = np.sort(sims[:, right], axis=1)[:, -8] - 1e-12  # the floor of each row is one of its scores
    prepare, near = matrices.pair_filter(True)
    found = {}
    for a, b, value in near(prepare(table), left, right, floors, keep, 1e-6, across=across):
        assert np.abs(value - sims[a, b]).max(initial=0) < 1e-14
        found |= dict.fromkeys(zip(a.tolist(), b.tolist()))
    for at in range(0, 20, 7):
        some = left[at : at + 7]
        pairs_of = [(a, b) for a in some for b in right if sims[a, b] >= floors[a]]
        best = sorted(pairs_of, key=lambda p: -sims[p])
        wanted = best[:keep] if across else [p for a in some for p in [q for q in best if q[0] == a][:keep]]
        assert set(wanted) <= set(found)


def test_best_pairs_of_blocks_that_mostly_meet_copy_no_vector(spark, monkeypatch):
    """Where bounds exclude little the blocks of songs meet in a cross join; no row is written for a song and a leaf."""
    rng = np.random.default_rng(10)
    x = np.abs(rng.normal(size=(300, 6)))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    rows = [(i, i, list(range(6)), [float(c) for c in v]) for i, v in enumerate(x)]
    df = save_stage(spark.createDataFrame(rows, "song_id long, seq long, term_ids array<int>, weights array<double>"), "paired")
    monkeypatch.setattr(neighbours, "FAN", 20)
    monkeypatch.setattr(neighbours, "BLOCK_CELLS", 8)
    met, meetings = [], neighbours.meetings
    monkeypatch.setattr(neighbours, "meetings", lambda *a: met.append(meetings(*a)) or met[-1])
    got = pairs.most_similar_pairs(df, 40, cell_rows=15).orderBy("rank").collect()
    assert [(r["song_a"], r["song_b"], r["similarity"]) for r in got] == brute_pairs(x, 40)
    assert len(met) == 1 and "cogroup" not in met[0]._jdf.queryExecution().executedPlan().toString().lower()


def test_numbers_of_queries_are_not_broadcast(spark):
    """Millions of numbers lie in files so small that Spark would send them through the driver."""
    vectors = ["array(0) AS term_ids", "array(1.0d) AS weights"]
    queries = save_stage(spark.range(400).selectExpr("id AS _qid", "id % 4 AS _own", "0.5d AS _floor", "id AS song_id", "id AS seq", *vectors), "asking")
    rows = save_stage(queries.selectExpr("song_id", "seq", "term_ids", "weights", "_own AS _leaf"), "placed")
    bounds = save_stage(spark.range(4).selectExpr("id AS _leaf", "id DIV 2 AS _block", "array(0) AS _ids", "array(1.0d) AS _tops"), "bounding")
    blocks = save_stage(queries.crossJoin(bounds.select("_block").distinct()).select("_qid", "_block"), "numbers")
    sent = neighbours.routed(queries, bounds, matrices.SPARSE, blocks)
    assert sent.count() == 400 * 3
    sent = save_stage(sent, "sent")
    kind = "_k1 bigint, _k2 bigint, song_id bigint, seq bigint, similarity double"
    asking = queries.selectExpr("*", "_qid AS _k1", "_qid AS _k2")
    met = neighbours.few_meetings(sent, asking, rows, matrices.SPARSE, neighbours._met(matrices.SPARSE, 2), kind)
    assert met.count() == 400 * 3 * 2
    for df in (neighbours.routed(queries, bounds, matrices.SPARSE, blocks), met):
        plan = df._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line and "_qid" in line]
        assert joins and not any("Broadcast" in line for line in joins), joins
