"""Compare recommendation lists of several models.

Lists are one long table: ``model, seed_id, rank, song_id, track_name, artist,
similarity``.  A (model, seed) that was not found has no rows there and
``found = false`` in the table of attempts ``model, seed_id, found``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.dedupe import SONG

NOT_FOUND = "[not found]"


def side_by_side(lists: DataFrame, left: str, right: str) -> DataFrame:
    """Two models by rank; a shorter list leaves NULLs."""

    def one(model: str, side: str) -> DataFrame:
        return lists.where(F.col("model") == model).select(
            "seed_id", "rank", *[F.col(c).alias(f"{side}_{c}") for c in ("track_name", "artist", "similarity")]
        )

    return one(left, "left").join(one(right, "right"), ["seed_id", "rank"], "full")


def rank_table(lists: DataFrame, attempts: DataFrame, models: list[str], k: int) -> DataFrame:
    """All models by rank, one column each, every rank 1..k present."""
    entry = F.concat_ws(" / ", "track_name", "artist")
    wide = lists.select("seed_id", "rank", "model", entry.alias("_e")).groupBy("seed_id", "rank").pivot(
        "model", models
    ).agg(F.first("_e"))
    frame = attempts.select("seed_id").distinct().withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return frame.join(wide, ["seed_id", "rank"], "left").select(
        "seed_id", "rank", *[F.coalesce(F.col(f"`{m}`"), F.lit(NOT_FOUND)).alias(m) for m in models]
    )


def _song_models(lists: DataFrame) -> DataFrame:
    """One row per seed and song with the models that list it."""
    return lists.groupBy("seed_id", *SONG).agg(F.collect_set("model").alias("_models"))


def overlap(lists: DataFrame, attempts: DataFrame) -> DataFrame:
    """Jaccard overlap of every two models per seed, both ways round.

    1 on the diagonal even for a model that was not found, NULL against one.
    Songs are folded first, so only pairs of models are ever formed and never
    pairs of songs.
    """
    songs = _song_models(lists)
    pairs = songs.select("seed_id", F.explode("_models").alias("model_a"), "_models").select(
        "seed_id", "model_a", F.explode("_models").alias("model_b")
    )
    shared = pairs.groupBy("seed_id", "model_a", "model_b").agg(F.count(F.lit(1)).alias("shared"))
    sizes = shared.where("model_a = model_b").select("seed_id", F.col("model_a").alias("model"), F.col("shared").alias("n"))
    tried = attempts.select("seed_id", "model", "found").join(sizes, ["seed_id", "model"], "left")
    tried = tried.select("seed_id", "model", "found", F.coalesce("n", F.lit(0)).alias("n"))
    a = tried.select("seed_id", F.col("model").alias("model_a"), F.col("found").alias("_fa"), F.col("n").alias("n_a"))
    b = tried.select("seed_id", F.col("model").alias("model_b"), F.col("found").alias("_fb"), F.col("n").alias("n_b"))
    both = a.join(b, "seed_id").join(shared, ["seed_id", "model_a", "model_b"], "left")
    hit = F.coalesce("shared", F.lit(0))
    union = F.col("n_a") + F.col("n_b") - hit
    score = F.when(F.col("model_a") == F.col("model_b"), 1.0).when(
        F.col("_fa") & F.col("_fb") & (union > 0), hit / union
    )
    return both.select("seed_id", "model_a", "model_b", hit.alias("shared"), "n_a", "n_b", score.alias("jaccard"))


def overlap_matrix(overlaps: DataFrame, models: list[str]) -> DataFrame:
    """The same as a square table per seed."""
    return overlaps.groupBy("seed_id", "model_a").pivot("model_b", models).agg(F.first("jaccard"))


def unique_to(lists: DataFrame, model: str) -> DataFrame:
    """Songs of one model with the other models that also list them.

    ``shared_with`` counts the other models; 0 means the song is unique.
    """
    songs = _song_models(lists).where(F.array_contains("_models", model))
    return songs.select("seed_id", *SONG, (F.size("_models") - 1).alias("shared_with"))


def unique_counts(lists: DataFrame, model: str) -> DataFrame:
    return unique_to(lists, model).groupBy("seed_id").agg(
        F.count_if(F.col("shared_with") == 0).alias("unique_songs"),
        F.count_if(F.col("shared_with") > 0).alias("shared_songs"),
    )


def listed_by_others(lists: DataFrame, model: str) -> DataFrame:
    """Songs on any other model's list."""
    return lists.where(F.col("model") != model).select("seed_id", *SONG).distinct()
