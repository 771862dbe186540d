"""Every operator as a named query over the sample tables.

A query takes ``(spark, sf_dir)`` and returns a DataFrame.  Models are fitted
once per session and folder and saved as stage tables, the way a user saves a
model before asking it for recommendations.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import text as tx
from kindred.functions.text import compute_once
from kindred.operators import compare, dedupe, filters, latent, pairs, project, seeds, stats, terms
from kindred.operators.embed import read_cache
from kindred.operators.lemmas import lemmatize
from kindred.operators.neighbours import all_neighbours
from kindred.operators.topk import top_k
from kindred.plans import corpus, inputs
from kindred.plans import recommenders as rec
from kindred.sources import library, lookup, tables
from kindred.sources.shared import save_stage, stage_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

K = 10
PAIRS = 15
SAMPLE = 500
MATCHED_SAMPLE = 400
LSA_FIT = 200
#: A sweep compares cuts to a quarter, half and all of what was fitted; lists come from half of it.
SWEEP = (4, 2, 1)
GIVEN_CUTS = [2, 4, 8]
GIVEN_SHARES = (1e-6, 1e-3, 0.9)
LEADING = 3
MODELS = ["tfidf", "tf", "chorus", "embedding"]

_FITTED: dict[tuple, object] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _fitted(make):
    """Fit once per session and input folder."""

    def get(spark: SparkSession, sf_dir: str):
        key = (make.__name__, sf_dir, spark.sparkContext.applicationId)
        if key not in _FITTED:
            _FITTED[key] = make(spark, sf_dir)
        return _FITTED[key]

    return get


def _r6(c):
    return F.round(c, 6)


# ------------------------------------------------------------------ corpora


@_fitted
def clean_songs(spark, sf_dir):
    kept = corpus.clean_corpus(inputs.headed_songs(spark, sf_dir))
    kept = kept.select(*rec.SONG_COLUMNS, tx.odd_tokens("tokens").alias("_odd"), "token_count", "processed_lyrics")
    tokens = tx.tokens_of("processed_lyrics", "_odd").alias("tokens")
    return save_stage(kept, "clean").select(*rec.SONG_COLUMNS, tokens, "token_count", "processed_lyrics")


@_fitted
def chorus_songs(spark, sf_dir):
    kept = corpus.chorus_corpus(inputs.headed_songs(spark, sf_dir))
    kept = kept.select(*rec.SONG_COLUMNS, tx.odd_tokens("tokens").alias("_odd"), "token_count", "chorus_text", "processed_chorus")
    tokens = tx.tokens_of("processed_chorus", "_odd").alias("tokens")
    return save_stage(kept, "chorus").select(*rec.SONG_COLUMNS, tokens, "token_count", "chorus_text", "processed_chorus")


@_fitted
def tfidf_model(spark, sf_dir):
    return rec.build_tfidf(clean_songs(spark, sf_dir))


@_fitted
def tf_model(spark, sf_dir):
    """The same corpus and vocabulary, weighted by counts alone."""
    base = tfidf_model(spark, sf_dir)
    vectors = terms.term_vectors(base.songs, base.vocabulary, use_idf=False)
    return rec.Recommender("tf", base.songs, save_stage(vectors, "tf-vectors"), base.vocabulary)


@_fitted
def chorus_model(spark, sf_dir):
    return rec.build_chorus(chorus_songs(spark, sf_dir))


@_fitted
def lsa_model(spark, sf_dir):
    """LSA_FIT components, or as many as a smaller corpus has; names and cuts follow the fit."""
    base = tfidf_model(spark, sf_dir)
    most = min(base.songs.count(), base.vocabulary.count())
    return rec.build_lsa(base, n_components=min(LSA_FIT, most))


def _letter_embedder():
    """A stand-in model for the embedding job: hashed word counts of the text."""

    def factory():
        import functools
        import hashlib

        @functools.lru_cache(1 << 16)
        def place(word):
            return hashlib.md5(word.encode()).digest()[0] % 32

        def embed(texts, max_length):
            out = []
            for t in texts:
                counts = [0.0] * 32
                for w in t.split(" ")[:max_length]:
                    counts[place(w)] += 1.0
                out.append(counts)
            return out

        return embed

    return factory


@_fitted
def embedding_cache(spark, sf_dir):
    return stage_path(spark, "embedding-cache")


def embedding_model(spark, sf_dir):
    return rec.build_embedding(
        clean_songs(spark, sf_dir), _letter_embedder(), embedding_cache(spark, sf_dir), model="letters"
    )


@_fitted
def seed_table(spark, sf_dir):
    return save_stage(inputs.artist_seeds(tfidf_model(spark, sf_dir).songs), "seeds")


@_fitted
def model_lists(spark, sf_dir):
    models = [m(spark, sf_dir) for m in (tfidf_model, tf_model, chorus_model, embedding_model)]
    lists, attempts = rec.compare_models(models, seed_table(spark, sf_dir), K)
    return save_stage(lists, "model-lists"), save_stage(attempts, "model-attempts")


# ------------------------------------------------------- cleaning and gates


@query
def clean_tokens(spark, sf_dir):
    """T1-T8, T10, F9"""
    df = inputs.marked_songs(spark, sf_dir).where("lyrics is not null")
    done = corpus.tokenized(df, "lyrics").withColumn("processed_lyrics", tx.join_tokens("tokens"))
    return done.select("song_id", "processed_lyrics", tx.token_count("processed_lyrics").alias("token_count"))


@query
def text_gates(spark, sf_dir):
    """F3-F6"""
    df = compute_once(inputs.marked_songs(spark, sf_dir).where("lyrics is not null"), low=F.lower("lyrics"))
    return df.select(
        "song_id",
        tx.has_narrow_metadata("lyrics", "low").alias("narrow"),
        tx.has_wide_metadata("lyrics", "low").alias("wide"),
        tx.has_prose_signal("lyrics", "low").alias("prose"),
        _r6(tx.type_token_ratio("low")).alias("ttr"),
        tx.is_likely_lyrics("lyrics", "low").alias("likely"),
    )


@query
def drop_report(spark, sf_dir):
    """F1-F8, F10, U1"""
    return corpus.clean_report(inputs.marked_songs(spark, sf_dir), prose_gate=True)


@query
def clean_corpus(spark, sf_dir):
    """F1-F3, F7, F8, U1 on marked texts"""
    kept = corpus.clean_corpus(inputs.marked_songs(spark, sf_dir))
    return kept.select("song_id", "track_name", "artist", "token_count", F.md5("processed_lyrics").alias("text_md5"))


@query
def blocklist_nullsafe(spark, sf_dir):
    """F1, F2"""
    df = inputs.marked_songs(spark, sf_dir)
    kept = filters.drop_missing_text(filters.drop_blocklisted(df, [("SRC3", "t0"), ("src5", "T1")]))
    return kept.select("song_id", "track_name", "artist")


@query
def lemma_tokens(spark, sf_dir):
    """T9 with a lemma table derived from the corpus"""
    df = corpus.tokenized(inputs.songs(spark, sf_dir), "lyrics").select("song_id", "tokens")
    plural = F.explode("tokens").alias("surface")
    lemmas = df.select(plural).distinct().where("length(surface) > 3 and surface like '%s'").select(
        "surface", F.expr("substring(surface, 1, length(surface) - 1)").alias("lemma")
    )
    done = lemmatize(df, save_stage(lemmas, "lemmas"))
    return done.select("song_id", tx.join_tokens("tokens").alias("processed_lyrics"))


@query
def truncated_tokens(spark, sf_dir):
    """T18"""
    df = clean_songs(spark, sf_dir)
    return df.select("song_id", tx.join_tokens(tx.truncate_tokens("tokens", 256)).alias("text"))


@query
def dedup_text(spark, sf_dir):
    """U1"""
    df = corpus.tokenized(inputs.songs(spark, sf_dir), "lyrics")
    return dedupe.first_by_text(df.withColumn("p", tx.join_tokens("tokens")), "p").select("song_id")


@query
def dedup_keys(spark, sf_dir):
    """U2"""
    df = inputs.marked_songs(spark, sf_dir)
    return dedupe.first_by_key(df, ["track_name", "artist"]).select("song_id", "track_name", "artist")


# -------------------------------------------------------------------- stats


@query
def token_stats(spark, sf_dir):
    """A6"""
    row = stats.describe(clean_songs(spark, sf_dir), "token_count")
    return row.select("count", *[_r6(c).alias(c) for c in row.columns if c != "count"])


@query
def token_histogram(spark, sf_dir):
    """A7"""
    h = stats.histogram(clean_songs(spark, sf_dir), "token_count", 50)
    return h.select("bin", _r6("low").alias("low"), _r6("high").alias("high"), "count")


@query
def corpus_shape(spark, sf_dir):
    """S9"""
    return tables.table_shape(clean_songs(spark, sf_dir), "track_name", "artist", "processed_lyrics")


# ------------------------------------------------------------- term vectors


@query
def vocabulary(spark, sf_dir):
    """A1, A2, T16, T17"""
    v = tfidf_model(spark, sf_dir).vocabulary
    return v.select("term", "term_id", "corpus_count", "doc_count", _r6("idf").alias("idf"))


@query
def vocabulary_listing(spark, sf_dir):
    """A5"""
    return terms.vocabulary_listing(tfidf_model(spark, sf_dir).vocabulary)


@query
def tfidf_weights(spark, sf_dir):
    """A3"""
    m = tfidf_model(spark, sf_dir)
    return terms.postings(m.vectors).select("song_id", "term_id", _r6("weight").alias("weight"))


@query
def transform_fitted(spark, sf_dir):
    """A4: conversation turns under the songs' vocabulary"""
    turns = inputs.read_table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("song_id"),
        F.col("turn").alias("seq"),
        F.col("text"),
    )
    vectors = terms.term_vectors(corpus.tokenized(turns, "text"), tfidf_model(spark, sf_dir).vocabulary)
    return terms.postings(vectors).select("song_id", "term_id", _r6("weight").alias("weight"))


@query
def doc_top_terms(spark, sf_dir):
    """M5c, W2"""
    m = tfidf_model(spark, sf_dir)
    return terms.top_terms(m.vectors, m.vocabulary, 20).select("song_id", "rank", "term", _r6("weight").alias("weight"))


# --------------------------------------------------------- seeds and top-k


@query
def seed_lookup(spark, sf_dir):
    """F11"""
    return seeds.match_seeds(tfidf_model(spark, sf_dir).songs, seed_table(spark, sf_dir)).select(
        "seed_id", "found", "song_id"
    )


@query
def song_inspect(spark, sf_dir):
    """F12"""
    return seeds.inspect_song(
        chorus_songs(spark, sf_dir), "t2", "SRC4", fields={"chorus_text": 600, "processed_chorus": 300}
    )


@query
def seed_topk(spark, sf_dir):
    """The flagship, one seed against the whole corpus"""
    return tfidf_model(spark, sf_dir).recommend("t1", "src2", k=K)


@query
def multi_seed_topk(spark, sf_dir):
    """J5, F13, W3"""
    lists, _ = tfidf_model(spark, sf_dir).recommend_many(seed_table(spark, sf_dir), K)
    return lists.select("seed_id", "rank", "song_id", "track_name", "artist", "similarity")


@query
def similar_pairs(spark, sf_dir):
    """J1, J3, J6, W5"""
    return pairs.most_similar_pairs(tfidf_model(spark, sf_dir).vectors, PAIRS)


@query
def text_neighbours(spark, sf_dir):
    """The five nearest songs of every song"""
    return all_neighbours(tfidf_model(spark, sf_dir).vectors, 5)


def _text_sample(spark, sf_dir):
    return pairs.sample_songs(tfidf_model(spark, sf_dir).vectors, SAMPLE)


@query
def sample_pair_scores(spark, sf_dir):
    """J7, J8"""
    return pairs.sample_pair_scores(_text_sample(spark, sf_dir))


@query
def sample_similarity_summary(spark, sf_dir):
    """A8, J7, J8"""
    row = stats.score_summary(pairs.sample_pair_scores(_text_sample(spark, sf_dir)))
    return row.select("pairs", *[_r6(c).alias(c) for c in row.columns if c != "pairs"])


@query
def sample_similarity_histogram(spark, sf_dir):
    """A7, J7"""
    scores = save_stage(pairs.sample_pair_scores(_text_sample(spark, sf_dir)), "sample-scores")
    h = stats.histogram(scores, "similarity", 80)
    return h.select("bin", _r6("low").alias("low"), "count")


# ----------------------------------------------------------- sections, chorus


@query
def sections(spark, sf_dir):
    """T11-T14"""
    blocks = compute_once(inputs.headed_songs(spark, sf_dir), _b=tx.section_blocks("lyrics"))
    return blocks.select("song_id", F.inline("_b")).select("song_id", "block_ix", "label", "text")


@query
def chorus_text(spark, sf_dir):
    """T15"""
    blocks = compute_once(inputs.headed_songs(spark, sf_dir), _b=tx.section_blocks("lyrics"))
    return blocks.select("song_id", tx.chorus_of_blocks("_b").alias("chorus_text"))


@query
def chorus_corpus(spark, sf_dir):
    """U2, F2, F4-F8, T3b, T11-T15"""
    return chorus_songs(spark, sf_dir).select(
        "song_id", "track_name", "artist", "token_count", F.md5("processed_chorus").alias("text_md5")
    )


@query
def chorus_report(spark, sf_dir):
    """F10"""
    return corpus.chorus_report(inputs.headed_songs(spark, sf_dir))


@query
def shared_corpus_songs(spark, sf_dir):
    """U4"""
    return dedupe.shared_songs(tfidf_model(spark, sf_dir).songs, chorus_songs(spark, sf_dir))


@query
def chorus_vs_full(spark, sf_dir):
    """Matched sample scored in both corpora"""
    full, chorus = tfidf_model(spark, sf_dir), chorus_model(spark, sf_dir)
    both = dedupe.shared_songs(full.songs, chorus.songs)
    keyed = both.withColumn("song_key", F.concat_ws("|", "track_name", "artist"))  # a NULL artist leaves the title
    sample = save_stage(pairs.sample_songs(keyed, MATCHED_SAMPLE, key="song_key"), "matched-sample")

    def summary(model):
        named = sample.select(F.col("track_name").alias("_t"), F.col("artist").alias("_a"))
        same = F.col("track_name").eqNullSafe(F.col("_t")) & F.col("artist").eqNullSafe(F.col("_a"))
        rows = model.songs.join(F.broadcast(named), same).select("song_id")
        scores = pairs.sample_pair_scores(model.vectors.join(F.broadcast(rows), "song_id"))
        row = stats.score_summary(scores, thresholds=(0.1, 0.3))
        return row.select(
            F.lit(model.name).alias("model"), "pairs", *[_r6(c).alias(c) for c in row.columns if c != "pairs"]
        )

    return summary(full).unionByName(summary(chorus))


# ------------------------------------------------------------------- dense


@query
def dense_topk(spark, sf_dir):
    """The first vector of each label as a seed"""
    v = inputs.dense_songs(spark, sf_dir)
    wanted = v.groupBy(F.col("label").alias("seed_id")).agg(F.min("song_id").alias("song_id"))
    return top_k(v, wanted, K)


@query
def dense_neighbours(spark, sf_dir):
    """The five nearest vectors of every vector"""
    return all_neighbours(inputs.dense_songs(spark, sf_dir), 5)


@query
def dense_pairs_summary(spark, sf_dir):
    """J2, J7, J8, A8"""
    sample = pairs.sample_songs(inputs.dense_songs(spark, sf_dir), SAMPLE)
    row = stats.score_summary(pairs.sample_pair_scores(sample), thresholds=(0.3, 0.5, 0.9))
    return row.select("pairs", *[_r6(c).alias(c) for c in row.columns if c != "pairs"])


@query
def mean_pool(spark, sf_dir):
    """Vectors pooled per label, masked by the quality flag"""
    v = inputs.dense_songs(spark, sf_dir)
    flags = inputs.read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("song_id"), "quality")
    masked = v.join(flags, "song_id", "left").withColumn("mask", F.coalesce("quality", F.lit(0)))
    pooled = project.mean_pool(masked.select(F.col("label").alias("pool"), "vector", "mask"), "pool")
    return pooled.select("pool", F.posexplode("vector").alias("dim", "value")).select("pool", "dim", _r6("value").alias("value"))


@query
def pca_2d(spark, sf_dir):
    """M7"""
    coords, ratios = project.principal_axes(inputs.dense_songs(spark, sf_dir), 2)
    return coords.select("song_id", *[_r6(c).alias(c) for c in ("pc1", "pc2")]).withColumn(
        "variance_ratio", F.lit(round(sum(ratios), 6))
    )


@query
def embed_cache(spark, sf_dir):
    """Rows added to the cache by a first run, a second, one with changed and missing texts,
    a forced one over half of the songs, and one that needs the other half"""
    songs, path = clean_songs(spark, sf_dir), stage_path(spark, "counted-cache")
    text = F.when(F.col("song_id") % 29 == 0, None).when(F.col("song_id") % 31 == 0, F.concat("processed_lyrics", F.lit(" x")))
    changed = songs.withColumn("processed_lyrics", text.otherwise(F.col("processed_lyrics")))
    runs, before = [], 0
    half = songs.where("song_id % 2 = 0")
    for run, table in enumerate((songs, songs, changed, half, songs), start=1):
        m = rec.build_embedding(table, _letter_embedder(), path, model="counted", force_recompute=run == 4)
        stored = read_cache(spark, f"{path}/model_key=counted-256").count()
        runs.append((run, m.vectors.count(), stored - before))
        before = stored
    return spark.createDataFrame(runs, "run int, songs long, embedded long")


@query
def embedding_topk(spark, sf_dir):
    """M6, J2, J5"""
    lists, _ = embedding_model(spark, sf_dir).recommend_many(seed_table(spark, sf_dir), K)
    return lists.select("seed_id", "rank", "song_id", "similarity")


# ------------------------------------------------------------- comparisons


@query
def four_model_table(spark, sf_dir):
    """J11"""
    lists, attempts = model_lists(spark, sf_dir)
    return compare.rank_table(lists, attempts, MODELS, K)


@query
def four_recommenders(spark, sf_dir):
    """The table over TF-IDF, latent vectors (of the given components), chorus and embedding"""
    models = [m(spark, sf_dir) for m in (tfidf_model, given_model, chorus_model, embedding_model)]
    lists, attempts = rec.compare_models(models, seed_table(spark, sf_dir), K)
    return compare.rank_table(save_stage(lists, "four-lists"), attempts, [m.name for m in models], K)


@query
def every_song_topk(spark, sf_dir):
    """Every song is a seed"""
    m = tfidf_model(spark, sf_dir)
    return top_k(m.vectors, m.songs.select(F.col("song_id").alias("seed_id"), "song_id"), 5)


@query
def side_by_side(spark, sf_dir):
    """J10"""
    return compare.side_by_side(model_lists(spark, sf_dir)[0], "tfidf", "chorus")


@query
def model_overlap(spark, sf_dir):
    """A9, A10"""
    o = compare.overlap(*model_lists(spark, sf_dir))
    return o.withColumn("jaccard", _r6("jaccard"))


@query
def overlap_matrix(spark, sf_dir):
    """A10, D17"""
    m = compare.overlap_matrix(compare.overlap(*model_lists(spark, sf_dir)), MODELS)
    return m.select("seed_id", "model_a", *[_r6(c).alias(c) for c in MODELS])


@query
def model_unique(spark, sf_dir):
    """A11"""
    return compare.unique_to(model_lists(spark, sf_dir)[0], "chorus")


@query
def model_unique_counts(spark, sf_dir):
    """A11"""
    return compare.unique_counts(model_lists(spark, sf_dir)[0], "chorus")


@query
def listed_by_others(spark, sf_dir):
    """U5"""
    return compare.listed_by_others(model_lists(spark, sf_dir)[0], "chorus")


@query
def list_set_operations(spark, sf_dir):
    """U3"""
    lists = model_lists(spark, sf_dir)[0]
    a, b = lists.where("model = 'tfidf'"), lists.where("model = 'chorus'")
    parts = {
        "both": dedupe.shared_songs(a, b),
        "either": dedupe.all_songs(a, b),
        "first only": dedupe.only_in_first(a, b),
    }
    tagged = [df.select(F.lit(name).alias("part"), "track_name", "artist") for name, df in parts.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


# ------------------------------------------------------------------- latent


@query
def lsa_topk(spark, sf_dir):
    """M1, M2, J4"""
    full = lsa_model(spark, sf_dir)
    m = rec.lsa_at(full, max(1, rec.components_of(full) // 2))
    lists, _ = m.recommend_many(seed_table(spark, sf_dir), K)
    return lists.select("seed_id", "rank", "song_id", "similarity")


@query
def lsa_topics(spark, sf_dir):
    """M5a, W2"""
    m = lsa_model(spark, sf_dir)
    return latent.topic_terms(m.extra["latent"].components, m.vocabulary, n_topics=20, n_terms=8)


@query
def lsa_song_topics(spark, sf_dir):
    """M5b"""
    return latent.song_topics(lsa_model(spark, sf_dir).vectors, 5)


@query
def lsa_variance(spark, sf_dir):
    """M3, M4, W4"""
    return latent.explained_variance(lsa_model(spark, sf_dir).extra["latent"].scores, tfidf_model(spark, sf_dir).vectors)


@query
def lsa_components_needed(spark, sf_dir):
    """M4"""
    return latent.components_needed(lsa_variance(spark, sf_dir))


@query
def lsa_sweep(spark, sf_dir):
    """M5d, A9: top lists of one fit cut to fewer components"""
    full = lsa_model(spark, sf_dir)
    lists, attempts = rec.sweep(full, seed_table(spark, sf_dir), K, [max(1, rec.components_of(full) // n) for n in SWEEP])
    return compare.overlap(save_stage(lists, "sweep"), attempts)


# The operators that use a fit, over a component table that SQL can compute too.


@_fitted
def given_model(spark, sf_dir):
    """Eight components whose loadings follow from the numbers of term and topic."""
    base = tfidf_model(spark, sf_dir)
    term = np.arange(base.vocabulary.count())[:, None]
    right = (term * 37 + np.arange(1, 9)[None, :] * 101) % 1000 / 1000 - 0.5
    scores = save_stage(latent.project_songs(base.vectors, right), "given-scores")
    extra = {"scores": scores, "components": latent.component_table(spark, right)}
    return rec.Recommender("given", base.songs, latent.unit_vectors(scores), base.vocabulary, extra)


@query
def given_topk(spark, sf_dir):
    """M2, J4"""
    lists, _ = given_model(spark, sf_dir).recommend_many(seed_table(spark, sf_dir), K)
    return lists.select("seed_id", "rank", "song_id", "similarity")


@query
def given_topics(spark, sf_dir):
    """M5a, W2"""
    m = given_model(spark, sf_dir)
    return latent.topic_terms(m.extra["components"], m.vocabulary, n_topics=8, n_terms=8)


@query
def given_song_topics(spark, sf_dir):
    """M2, M5b"""
    return latent.song_topics(given_model(spark, sf_dir).vectors, 5)


@query
def given_variance(spark, sf_dir):
    """M3, M4, W4"""
    v = latent.explained_variance(given_model(spark, sf_dir).extra["scores"], tfidf_model(spark, sf_dir).vectors)
    return v.select("component", _r6("ratio").alias("ratio"), _r6("cumulative").alias("cumulative"))


@query
def given_components_needed(spark, sf_dir):
    """M4: the first component count that reaches each share"""
    v = latent.explained_variance(given_model(spark, sf_dir).extra["scores"], tfidf_model(spark, sf_dir).vectors)
    return latent.components_needed(v, thresholds=GIVEN_SHARES)


@query
def given_sweep(spark, sf_dir):
    """M5d, A9: lists at several cuts of the components, and their overlap"""
    lists, attempts = rec.sweep(given_model(spark, sf_dir), seed_table(spark, sf_dir), K, GIVEN_CUTS)
    return compare.overlap(save_stage(lists, "given-sweep"), attempts).withColumn("jaccard", _r6("jaccard"))


@_fitted
def leading_fit(spark, sf_dir):
    return latent.fit_latent(tfidf_model(spark, sf_dir).vectors, n_components=LEADING, tolerance=1e-11)


@query
def leading_scores(spark, sf_dir):
    """M1, M2: the strongest components of the term matrix and every song's score on them"""
    scores = leading_fit(spark, sf_dir).scores
    return scores.select("song_id", F.posexplode("vector").alias("_i", "score")).select(
        "song_id", (F.col("_i") + 1).alias("component"), F.round("score", 5).alias("score")
    )


@query
def leading_quality(spark, sf_dir):
    """M1: singular values, and whether residuals and angles keep their limits"""
    limits = [(F.col("residual") <= 1e-9).alias("converged"), (F.col("orthogonality") <= 1e-12).alias("orthogonal")]
    return leading_fit(spark, sf_dir).residuals.select("component", F.round("sigma", 5).alias("sigma"), *limits)


# ------------------------------------------------------------------ sources


@query
def flatten_pages(spark, sf_dir):
    """Pages landed as JSON, read with a schema, flattened"""
    path = stage_path(spark, "pages")
    inputs.library_pages(spark, sf_dir).write.json(path)
    return library.flatten_tracks(library.read_library_pages(spark, path))


def _enriched(spark, sf_dir):
    tracks = library.flatten_tracks(inputs.library_pages(spark, sf_dir))
    d, flags = inputs.read_table(spark, sf_dir, "documents"), inputs.read_table(spark, sf_dir, "labels")
    landed = d.join(flags, "doc_id").select(
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("T"), F.expr("cast(doc_id div 40 as string)")).alias("track_name"),
        F.col("source").alias("artist"),
        F.col("text").alias("lyrics"),
    )
    return lookup.attach_lyrics(tracks, landed)


@query
def enrich_lyrics(spark, sf_dir):
    """S5"""
    return _enriched(spark, sf_dir).select("track_id", "track_name", "artist", F.md5("lyrics").alias("text_md5"), "status")


@query
def lyrics_coverage(spark, sf_dir):
    """S6"""
    return lookup.coverage(_enriched(spark, sf_dir))


@query
def csv_round_trip(spark, sf_dir):
    """S1, S2"""
    path = stage_path(spark, "csv")
    df = inputs.marked_songs(spark, sf_dir).select(
        F.col("song_id").cast("string").alias("track_id"), "track_name", "artist", "lyrics"
    )
    tables.write_csv_table(df, path)
    back = tables.read_csv_table(spark, path, tables.LYRICS)
    return back.select("track_id", "track_name", "artist", F.md5("lyrics").alias("text_md5"))
