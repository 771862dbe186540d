"""The four recommenders as saved models with one calling convention.

Each builder takes a clean corpus (``song_id, seq, track_name, artist,
tokens``), saves the tables it needs and returns a ``Recommender``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import text as tx
from kindred.functions import wordlists as wl
from kindred.operators import latent, terms
from kindred.operators.dedupe import first_by_key
from kindred.operators.embed import cached_embeddings
from kindred.operators.seeds import find_song, match_seeds
from kindred.operators.topk import top_k, top_k_at_cuts
from kindred.sources.shared import save_stage

BROADCAST_LISTS = 1_000_000
SONG_COLUMNS = ["song_id", "seq", "track_name", "artist"]


@dataclass
class Recommender:
    """A corpus with one vector per song."""

    name: str
    songs: DataFrame
    vectors: DataFrame
    vocabulary: DataFrame | None = None
    extra: dict = field(default_factory=dict)
    default_k: int = 10

    def recommend(self, title: str, artist: str | None = None, k: int | None = None) -> DataFrame:
        """``rank, track_name, artist, similarity`` for one seed; ValueError if absent."""
        seed = find_song(self.songs, title, artist)
        k = self.default_k if k is None else k
        one = self.songs.sparkSession.createDataFrame(
            [(0, seed["song_id"])], f"seed_id int, song_id {self.songs.schema['song_id'].dataType.simpleString()}"
        )
        return self._named(top_k(self.vectors, one, k), k).select("rank", "track_name", "artist", "similarity")

    def recommend_many(self, seeds: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
        """Lists for many seeds, and which seeds were found.

        Returns the long list table and the attempts table that the comparison
        operators expect.
        """
        matched = save_stage(match_seeds(self.songs, seeds), "matched")
        found = matched.where("found").select("seed_id", "song_id")
        lists = self._named(top_k(self.vectors, found, k), k * found.count()).select(
            F.lit(self.name).alias("model"), "seed_id", "rank", "song_id", "track_name", "artist", "similarity"
        )
        return lists, matched.select(F.lit(self.name).alias("model"), "seed_id", "found")

    def top_terms(self, title: str, artist: str | None = None, n: int = 20) -> DataFrame:
        """Heaviest terms of one song: ``rank, term, weight``."""
        return terms.top_terms(self._one(title, artist), self.vocabulary, n).drop("song_id")

    def top_topics(self, title: str, artist: str | None = None, n: int = 5) -> DataFrame:
        """Strongest topics of one song: ``rank, topic, score``."""
        return latent.song_topics(self._one(title, artist), n).drop("song_id")

    def _one(self, title: str, artist: str | None) -> DataFrame:
        seed = find_song(self.songs, title, artist)
        return self.vectors.where(F.col("song_id") == F.lit(seed["song_id"]))

    def _named(self, lists: DataFrame, rows: int) -> DataFrame:
        # At most k rows per seed, so the count of seeds bounds the lists.
        side = F.broadcast(lists) if rows <= BROADCAST_LISTS else lists
        return self.songs.select("song_id", "track_name", "artist").join(side, "song_id")


def _model_corpus(songs: DataFrame, *extra: str) -> DataFrame:
    return first_by_key(songs.select(*SONG_COLUMNS, *extra), ["track_name", "artist"])


def build_tfidf(
    songs: DataFrame,
    *,
    name: str = "tfidf",
    distinct_songs: bool = True,
    use_idf: bool = True,
    max_features: int = wl.MAX_FEATURES,
    min_df: int = wl.MIN_DF,
    default_k: int = 5,
) -> Recommender:
    """TF-IDF over unigrams and bigrams."""
    songs = songs.select(*SONG_COLUMNS, tx.join_tokens("tokens").alias("_text"), tx.odd_tokens("tokens").alias("_odd"))
    corpus = _model_corpus(songs, "_text", "_odd") if distinct_songs else songs
    corpus = save_stage(corpus.select(*SONG_COLUMNS, tx.tokens_of("_text", "_odd").alias("tokens")), f"{name}-songs")
    vocabulary = save_stage(
        terms.fit_vocabulary(corpus, max_features=max_features, min_df=min_df), f"{name}-vocabulary"
    )
    vectors = save_stage(terms.term_vectors(corpus, vocabulary, use_idf=use_idf), f"{name}-vectors")
    return Recommender(name, corpus, vectors, vocabulary, default_k=default_k)


def build_chorus(chorus_songs: DataFrame, *, name: str = "chorus", **options) -> Recommender:
    """TF-IDF over chorus texts, whose corpus already holds each song once."""
    return build_tfidf(chorus_songs, name=name, distinct_songs=False, default_k=10, **options)


def build_lsa(
    tfidf: Recommender, *, n_components: int = latent.COMPONENTS, name: str = "lsa", tolerance: float = latent.TOLERANCE
) -> Recommender:
    """Latent semantic vectors on top of a fitted TF-IDF model."""
    model = latent.fit_latent(tfidf.vectors, n_components=n_components, tolerance=tolerance)
    return Recommender(name, tfidf.songs, model.vectors, tfidf.vocabulary, {"latent": model, "tfidf": tfidf})


def components_of(model: Recommender) -> int:
    """How many components a latent model was fitted with."""
    return len(model.extra["latent"].singular_values)


def lsa_at(model: Recommender, n_components: int) -> Recommender:
    """The same fit cut to fewer components: leading components do not change.

    ValueError beyond the components that were fitted.
    """
    fitted = components_of(model)
    if not 1 <= n_components <= fitted:
        raise ValueError(f"{n_components} components asked for, {fitted} fitted")
    vectors = latent.unit_vectors(model.extra["latent"].scores, n_components)
    return Recommender(f"{model.name}_{n_components}", model.songs, vectors, model.vocabulary, model.extra)


def sweep(model: Recommender, seeds: DataFrame, k: int, cuts: list[int]) -> tuple[DataFrame, DataFrame]:
    """Lists and attempts of one latent fit cut to several numbers of components, found in one scan."""
    scores = model.extra["scores"] if "scores" in model.extra else model.extra["latent"].scores
    matched = save_stage(match_seeds(model.songs, seeds), "matched")
    found = top_k_at_cuts(scores, matched.where("found").select("seed_id", "song_id"), k, cuts)
    name = F.concat(F.lit(f"{model.name}_"), F.col("cut").cast("string")).alias("model")
    named = model.songs.select("song_id", "track_name", "artist").join(found, "song_id")
    lists = named.select(name, "seed_id", "rank", "song_id", "track_name", "artist", "similarity")
    each = F.explode(F.array(*[F.lit(c) for c in sorted(set(cuts))])).alias("cut")
    return lists, matched.select("seed_id", "found", each).select(name, "seed_id", "found")


def build_embedding(
    songs: DataFrame,
    embed_factory: Callable,
    cache_path: str,
    *,
    model: str,
    text: str = "processed_lyrics",
    name: str = "embedding",
    force_recompute: bool = False,
    batch_size: int = 8,
    max_length: int = 256,
) -> Recommender:
    """Vectors of a user-supplied model, cached by content."""
    corpus = save_stage(_model_corpus(songs, text), f"{name}-songs")
    vectors = cached_embeddings(
        corpus, embed_factory, cache_path, model=model, text=text,
        force_recompute=force_recompute, batch_size=batch_size, max_length=max_length,
    )
    placed = corpus.select("song_id", "seq").join(vectors.select("song_id", "vector"), "song_id")
    return Recommender(name, corpus, save_stage(placed, f"{name}-vectors"))


def compare_models(models: list[Recommender], seeds: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Lists and attempts of several models for the same seeds."""
    results = [m.recommend_many(seeds, k) for m in models]
    lists, attempts = results[0]
    for more, tried in results[1:]:
        lists, attempts = lists.unionByName(more), attempts.unionByName(tried)
    return lists, attempts
