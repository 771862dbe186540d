"""Batch embedding with a cache table keyed by content.

``embed_factory()`` is called once per task and returns a function from a list
of texts to a list (or array) of vectors, so a model is loaded once per task
and sees ``batch_size`` texts at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators.dedupe import text_key

VERSIONS = "version bigint, part string"

def _cache_schema(songs: DataFrame) -> str:
    """Ids keep the type they have in the corpus."""
    kind = songs.schema["song_id"].dataType.simpleString()
    return f"song_id {kind}, content_hash string, model string, vector array<float>"


def embedding_inputs(songs: DataFrame, model: str, text: str = "processed_lyrics") -> DataFrame:
    """``song_id, text, content_hash, model``; a missing text counts as empty."""
    filled = F.coalesce(F.col(text), F.lit(""))
    return songs.select("song_id", filled.alias("text")).select(
        "song_id", "text", text_key("text").alias("content_hash"), F.lit(model).alias("model")
    )


def generate_embeddings(
    inputs: DataFrame, embed_factory: Callable, *, batch_size: int = 8, max_length: int = 256
) -> DataFrame:
    """Embed every input row in batches: ``song_id, content_hash, model, vector``."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        embed = embed_factory()
        for batch in batches:
            texts, blocks = batch.column("text").to_pylist(), []
            for start in range(0, len(texts), batch_size):
                blocks += [np.asarray(v, "float32") for v in embed(texts[start : start + batch_size], max_length)]
            ends = np.concatenate([[0], np.cumsum([len(v) for v in blocks])]).astype("int32")
            flat = np.concatenate(blocks) if blocks else np.empty(0, "float32")
            vectors = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.float32()))
            kept = [batch.column(c) for c in ("song_id", "content_hash", "model")]
            yield pa.RecordBatch.from_arrays([*kept, vectors], ["song_id", "content_hash", "model", "vector"])

    return inputs.mapInArrow(run, _cache_schema(inputs))


def _parts(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The latest version of a cache and its part folders; version 0 has none."""
    try:
        rows = spark.read.schema(VERSIONS).parquet(f"{path}/versions").collect()  # a row per part and version
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, []
    last = max(r.version for r in rows)
    return last, sorted({r.part for r in rows if r.version == last})


def _publish(spark: SparkSession, path: str, version: int, parts: list[str]) -> None:
    """Make parts the current version: one file that appears whole or not at all."""
    table = spark.createDataFrame([(version, part) for part in parts], VERSIONS)
    table.coalesce(1).write.mode("append").parquet(f"{path}/versions")


def read_cache(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The current version of a model's cache, or an empty table where nothing was published yet."""
    schema = schema or "song_id bigint, content_hash string, model string, vector array<float>"
    _, parts = _parts(spark, path)
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{part}" for part in parts])


def cached_embeddings(
    songs: DataFrame,
    embed_factory: Callable,
    cache_path: str,
    *,
    model: str,
    text: str = "processed_lyrics",
    force_recompute: bool = False,
    batch_size: int = 8,
    max_length: int = 256,
) -> DataFrame:
    """Vectors of all songs, embedding only what the cache lacks.

    A cached row counts only for the same song, text, model and length limit.
    Each run writes part folders of its own below the model's folder in
    ``cache_path`` and publishes them as a new version when they are complete,
    so a run that fails leaves the version before it.  A forced run embeds all
    its songs anew and keeps the vectors of all others.  One run writes a
    model's cache at a time.
    """
    spark = songs.sparkSession
    key, schema = ["song_id", "content_hash", "model"], _cache_schema(songs)
    inputs = embedding_inputs(songs, f"{model}@{max_length}", text)
    target = f"{cache_path}/model_key={_folder(model, max_length)}"
    version, parts = _parts(spark, target)
    known = read_cache(spark, target, schema)
    missing = inputs if force_recompute else inputs.join(known.select(key), key, "left_anti")
    if force_recompute or not missing.isEmpty():
        missing = missing.dropDuplicates(key)
        run = uuid.uuid4().hex[:12]
        fresh = generate_embeddings(missing, embed_factory, batch_size=batch_size, max_length=max_length)
        fresh.write.parquet(f"{target}/part-{run}")
        if force_recompute and parts:
            known.join(inputs.select(key), key, "left_anti").write.parquet(f"{target}/kept-{run}")
            parts = [f"kept-{run}"]
        _publish(spark, target, version + 1, [*parts, f"part-{run}"])
    stored = read_cache(spark, target, schema)
    return inputs.drop("text").join(stored, key).select("song_id", "content_hash", "vector")


def _folder(model: str, max_length: int) -> str:
    return "".join(c if c.isalnum() or c in "-_" else "_" for c in model) + f"-{max_length}"
