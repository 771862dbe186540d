"""Latent vectors, projections, pooling, embedding cache and comparisons."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import compare, embed, latent, project, terms
from kindred.plans import recommenders as rec
from kindred.sources.shared import save_stage, stage_path
from tests.test_similarity import make_songs


@pytest.fixture(scope="module")
def tfidf(spark):
    rows = [(i, s, f"T{i // 4}", f"a{i % 4}", t) for i, s, t in make_songs(n=50)]
    songs = spark.createDataFrame(rows, "song_id long, seq long, track_name string, artist string, tokens array<string>")
    return rec.build_tfidf(songs.repartition(6))


def dense_matrix(model):
    width = model.vocabulary.count()
    rows = model.vectors.orderBy("seq").collect()
    x = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        x[i, r["term_ids"]] = r["weights"]
    return [r["song_id"] for r in rows], x


def test_svd_matches_full_decomposition(tfidf, monkeypatch):
    monkeypatch.setattr(latent, "CHUNK_ROWS", 7)
    ids, x = dense_matrix(tfidf)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    model = latent.fit_latent(tfidf.vectors, n_components=8, tolerance=1e-7)
    assert model.singular_values == pytest.approx(s[:8], rel=1e-6)
    for j in range(8):
        assert abs(vt[j] @ model.right[:, j]) == pytest.approx(1, abs=1e-5)
        assert model.right[np.abs(model.right[:, j]).argmax(), j] > 0
    got = {r["song_id"]: np.array(r["vector"]) for r in model.scores.collect()}
    want = x @ model.right
    for i, sid in enumerate(ids):
        assert got[sid] == pytest.approx(want[i], abs=1e-9)
    for r in model.vectors.collect():
        norm = np.linalg.norm(r["vector"])
        assert norm == pytest.approx(1) or norm == 0

    table = latent.explained_variance(model.scores, tfidf.vectors).orderBy("component").collect()
    ratio = want.var(axis=0) / x.var(axis=0).sum()
    assert [r["ratio"] for r in table] == pytest.approx(list(ratio))
    assert [r["cumulative"] for r in table] == pytest.approx(list(np.cumsum(ratio)))
    cut = float(np.cumsum(ratio)[2])
    need = {
        r["threshold"]: r["components"]
        for r in latent.components_needed(latent.explained_variance(model.scores, tfidf.vectors), (cut - 1e-9, 0.9999)).collect()
    }
    assert need == {cut - 1e-9: 3, 0.9999: None}

    terms_table = latent.topic_terms(model.components, tfidf.vocabulary, n_topics=3, n_terms=4).collect()
    names = [r["term"] for r in tfidf.vocabulary.orderBy("term_id").collect()]
    for topic in (1, 2, 3):
        order = sorted(range(len(names)), key=lambda t: (-model.right[t, topic - 1], names[t]))[:4]
        mine = sorted((r["rank"], r["term"]) for r in terms_table if r["topic"] == topic)
        assert [t for _, t in mine] == [names[t] for t in order]

    best = latent.song_topics(model.vectors, 3).where(F.col("song_id") == ids[3]).orderBy("rank").collect()
    unit = want[3] / np.linalg.norm(want[3])
    order = np.argsort(-np.abs(unit))[:3]
    assert [r["topic"] for r in best] == list(order + 1)
    assert [r["score"] for r in best] == pytest.approx([round(v, 4) for v in unit[order]])


def test_svd_does_not_depend_on_partitions(tfidf):
    one = latent.fit_latent(tfidf.vectors.repartition(1), n_components=5, tolerance=1e-6)
    many = latent.fit_latent(tfidf.vectors.repartition(13), n_components=5, tolerance=1e-6)
    assert one.singular_values == pytest.approx(many.singular_values)
    with pytest.raises(ValueError):
        latent.fit_latent(tfidf.vectors, n_components=10_000)


def test_lsa_cut_equals_leading_components(tfidf):
    full = rec.build_lsa(tfidf, n_components=10)
    topics = full.top_topics("t2", "A1", 3).orderBy("rank").collect()
    assert len(topics) == 3 and abs(topics[0]["score"]) >= abs(topics[1]["score"]) >= abs(topics[2]["score"])
    with pytest.raises(ValueError):
        full.top_topics("t2", "nobody")
    cut = rec.lsa_at(full, 4)
    got = {r["song_id"]: np.array(r["vector"]) for r in cut.vectors.collect()}
    for r in full.extra["latent"].scores.collect():
        head = np.array(r["vector"][:4])
        norm = np.linalg.norm(head)
        assert got[r["song_id"]] == pytest.approx(head / norm if norm else head)


def test_pca_is_centred(spark):
    x = np.random.default_rng(0).normal(size=(80, 5)) * [5, 3, 1, 1, 1] + 7
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "song_id long, vector array<float>")
    coords, ratios = project.principal_axes(df, 2)
    got = np.array([[r["pc1"], r["pc2"]] for r in coords.orderBy("song_id").collect()])
    c = x.astype("float32").astype(float)
    c = c - c.mean(0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    want = c @ vt[:2].T
    for j in range(2):
        assert np.abs(got[:, j]) == pytest.approx(np.abs(want[:, j]), abs=1e-6)
        peak = vt[j][np.abs(vt[j]).argmax()]
        assert got[:, j] * np.sign(peak) == pytest.approx(want[:, j], abs=1e-6)
    assert ratios == pytest.approx(list((s**2 / (s**2).sum())[:2]))


def test_mean_pool(spark):
    rows = [("a", [1.0, 2.0], 1), ("a", [3.0, 6.0], 1), ("a", [9.0, 9.0], 0), ("b", [5.0, 5.0], 0)]
    df = spark.createDataFrame(rows, "song_id string, vector array<float>, mask int")
    got = {r["song_id"]: r["vector"] for r in project.mean_pool(df).collect()}
    assert got == {"a": [2.0, 4.0], "b": [0.0, 0.0]}


def toy_factory(calls_path):
    def factory():
        def embed_texts(texts, max_length):
            with open(calls_path, "a") as f:
                f.write("".join(f"{len(texts)}\n" for _ in texts))
            return [[float(len(t)), float(t.count("a"))] for t in texts]

        return embed_texts

    return factory


def test_embedding_cache(spark, tmp_path):
    calls = tmp_path / "calls"
    factory = toy_factory(str(calls))
    songs = spark.createDataFrame([(i, "a" * i if i else None) for i in range(20)], "song_id long, processed_lyrics string")
    cache = stage_path(spark, "cache")

    def run(df, **kw):
        calls.write_text("")
        out = {r["song_id"]: list(r["vector"]) for r in embed.cached_embeddings(df, factory, cache, model="toy/1", **kw).collect()}
        sizes = [int(s) for s in calls.read_text().split()]
        assert all(s <= 8 for s in sizes)
        return out, len(sizes)

    out, n = run(songs)
    assert n == 20 and out[0] == [0.0, 0.0] and out[7] == [7.0, 7.0]
    assert run(songs)[1] == 0
    changed = songs.withColumn("processed_lyrics", F.when(F.col("song_id") == 3, "xyz").otherwise(F.col("processed_lyrics")))
    out, n = run(changed)  # same row count, other text
    assert n == 1 and out[3] == [3.0, 0.0]
    assert run(songs, force_recompute=True)[1] == 20
    assert run(songs, max_length=16)[1] == 20
    half = songs.where("song_id < 10")
    assert run(half, force_recompute=True)[1] == 10
    assert run(songs)[1] == 0  # the other half is still there
    assert run(changed)[1] == 0
    assert embed.read_cache(spark, f"{cache}/model_key=toy_1-256").groupBy("song_id", "content_hash").count().where("count > 1").count() == 0


def test_a_run_that_fails_leaves_the_cache(spark):
    def factory(fails):
        def make():
            def embed_texts(texts, max_length):
                if fails and "aaaa" in texts:
                    raise RuntimeError("killed")
                return [[float(len(t))] for t in texts]

            return embed_texts

        return make

    songs = spark.createDataFrame([(i, "a" * i) for i in range(12)], "song_id long, processed_lyrics string").repartition(6)
    cache = stage_path(spark, "cache")
    before = sorted(map(str, embed.cached_embeddings(songs, factory(False), cache, model="m").collect()))
    for forced in (songs, songs.where("song_id < 6")):
        with pytest.raises(Exception, match="killed"):
            embed.cached_embeddings(forced, factory(True), cache, model="m", force_recompute=True).collect()
        assert sorted(map(str, embed.cached_embeddings(songs, factory(True), cache, model="m").collect())) == before


def test_recommend_and_compare(tfidf, spark):
    with pytest.raises(ValueError):
        tfidf.recommend("no such song")
    one = tfidf.recommend("t2", "A1", k=5).orderBy("rank").collect()
    assert [r["rank"] for r in one] == [1, 2, 3, 4, 5]
    assert ("T2", "a1") not in {(r["track_name"], r["artist"]) for r in one}
    assert tfidf.recommend("t2", "A1").count() == 5
    heavy = tfidf.top_terms("T2", "a1", 3).orderBy("rank").collect()
    ids, x = dense_matrix(tfidf)
    mine = np.sort(x[ids.index(9)])[::-1][:3]
    assert [r["weight"] for r in heavy] == pytest.approx(list(mine))
    tf = rec.build_tfidf(tfidf.songs, name="tf", use_idf=False)
    seeds = spark.createDataFrame([("x", "T2", "a1"), ("y", "t5", ""), ("z", "gone", None)],
                                  "seed_id string, seed_title string, seed_artist string")
    lists, attempts = rec.compare_models([tfidf, tf], seeds, k=5)
    assert {(r["model"], r["seed_id"]): r["found"] for r in attempts.collect()} == {
        (m, s): s != "z" for m in ("tfidf", "tf") for s in "xyz"
    }
    got = lists.collect()
    assert [(r["track_name"], r["artist"], r["similarity"]) for r in sorted(got, key=lambda r: r["rank"])
            if r["model"] == "tfidf" and r["seed_id"] == "x"] == [(r["track_name"], r["artist"], r["similarity"]) for r in one]
    sets = {(m, s): {(r["track_name"], r["artist"]) for r in got if (r["model"], r["seed_id"]) == (m, s)}
            for m in ("tfidf", "tf") for s in "xyz"}
    for r in compare.overlap(lists, attempts).collect():
        a, b = sets[r["model_a"], r["seed_id"]], sets[r["model_b"], r["seed_id"]]
        if r["model_a"] == r["model_b"]:
            assert r["jaccard"] == 1.0
        elif r["seed_id"] == "z":
            assert r["jaccard"] is None
        else:
            assert r["jaccard"] == pytest.approx(len(a & b) / len(a | b)) and r["shared"] == len(a & b)
    for r in compare.unique_counts(lists, "tf").collect():
        mine, other = sets["tf", r["seed_id"]], sets["tfidf", r["seed_id"]]
        assert (r["unique_songs"], r["shared_songs"]) == (len(mine - other), len(mine & other))
    table = compare.rank_table(lists, attempts, ["tfidf", "tf", "lsa"], 5).collect()
    assert len(table) == 15
    assert all(r["lsa"] == "[not found]" for r in table)
    assert all((r["tf"] == "[not found]") == (r["seed_id"] == "z") for r in table)
    both = compare.side_by_side(lists, "tfidf", "tf").collect()
    assert len(both) == 10
    square = compare.overlap_matrix(compare.overlap(lists, attempts), ["tfidf", "tf"]).collect()
    assert len(square) == 6


def test_krylov_passes_follow_the_spectrum_and_restart():
    rng = np.random.default_rng(2)
    base = np.linalg.qr(rng.normal(size=(300, 300)))[0]
    for values, few in ((np.r_[1000.0, 400.0, 200.0, np.full(297, 1.0)], True), (np.linspace(0.5, 1.5, 300), False)):
        g = base @ np.diag(np.sort(values)[::-1]) @ base.T
        found, vectors, residual, passes = latent._leading(lambda q: g @ q, 300, 3, 1e-4, 1)
        assert found == pytest.approx(np.sort(values)[::-1][:3], rel=1e-4) and residual.max() <= 1e-4
        assert np.abs(vectors.T @ vectors - np.eye(3)).max() < 1e-10
        assert (passes <= 4) == few
    singular = base[:, :2] @ base[:, :2].T  # two directions of one value, nothing else
    found, vectors, residual, _ = latent._leading(lambda q: singular @ q, 300, 5, 1e-6, 1)
    assert found == pytest.approx([1, 1, 0, 0, 0], abs=1e-9)
    with pytest.raises(RuntimeError):
        latent._leading(lambda q: rng.normal(size=q.shape), 300, 3, 1e-12, 1)


def test_residuals_are_those_of_the_matrix(spark):
    rng = np.random.default_rng(3)
    x = np.where(rng.random((60, 40)) < 0.2, rng.random((60, 40)), 0)
    rows = [(i, i, np.flatnonzero(r).tolist(), r[r > 0].tolist()) for i, r in enumerate(x)]
    df = save_stage(spark.createDataFrame(rows, "song_id long, seq long, term_ids array<int>, weights array<double>"), "sparse-rows")
    model = latent.fit_latent(df, n_components=4, tolerance=1e-3)
    x = x[:, : model.right.shape[0]]
    for r in model.residuals.collect():
        v = model.right[:, r.component - 1]
        assert r.residual == pytest.approx(np.linalg.norm(x.T @ (x @ v) - r.sigma**2 * v) / r.sigma**2, abs=1e-8)
        assert r.residual <= 1e-3 and r.orthogonality < 1e-10


def test_covariance_with_large_means(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 4)) + [1e6, -1e6, 0, 5]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "song_id long, vector array<double>").repartition(7)
    n, mean, covariance = project.moments(df)
    assert n == 200 and mean == pytest.approx(x.mean(0)) and covariance == pytest.approx(np.cov(x.T), rel=1e-8, abs=1e-9)


def test_lists_at_several_cuts_equal_separate_searches(spark):
    from kindred.operators import topk

    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 6))
    x[5] = 0
    x[7, :2] = 0
    df = save_stage(spark.createDataFrame([(i, 100 - i, [float(v) for v in r]) for i, r in enumerate(x)], "song_id long, seq long, vector array<double>").repartition(3), "cuts")
    seeds = spark.createDataFrame([("a", 3), ("b", 7), ("c", 5), ("d", 3)], "seed_id string, song_id long")
    got = topk.top_k_at_cuts(df, seeds, 4, [6, 2, 3]).collect()
    for cut in (2, 3, 6):
        want = topk.top_k(df.withColumn("vector", F.slice("vector", 1, cut)), seeds, 4).collect()
        assert sorted((r.seed_id, r["rank"], r.song_id, r.similarity) for r in got if r["cut"] == cut) == sorted(map(tuple, want))
    assert topk.top_k_at_cuts(df, seeds.where("false"), 4, [2]).count() == 0
    with pytest.raises(ValueError):
        topk.top_k_at_cuts(df, df.select(F.explode(F.sequence(F.lit(1), F.lit(20))).alias("seed_id"), "song_id"), 4, [2])


def test_a_pass_has_a_share_for_each_core_and_not_for_each_shuffle_task(spark, monkeypatch):
    x = np.random.default_rng(9).random((120, 12))
    rows = [(i, i, list(range(12)), [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "song_id long, seq long, term_ids array<int>, weights array<double>").repartition(60)
    tasks, gram_pass = [], latent._gram_pass
    monkeypatch.setattr(latent, "_gram_pass", lambda v, q: tasks.append(v.rdd.getNumPartitions()) or gram_pass(v, q))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        model = latent.fit_latent(df, n_components=3, tolerance=1e-9)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert max(tasks) <= spark.sparkContext.defaultParallelism
    assert np.allclose(model.singular_values, np.linalg.svd(x, compute_uv=False)[:3])


def test_terms_of_one_loading_follow_the_alphabet(spark):
    loadings = spark.createDataFrame([(1, 0, 0.3), (1, 1, 0.3 + 1e-15), (1, 2, 0.4)], "topic int, term_id int, loading double")
    names = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "term_id int, term string")
    got = latent.topic_terms(loadings, names, n_topics=1, n_terms=3).orderBy("rank").collect()
    assert [r["term"] for r in got] == ["c", "a", "b"]
