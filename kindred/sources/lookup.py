"""Attach landed lyrics to tracks by title and artist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.dedupe import first_by_key


def attach_lyrics(tracks: DataFrame, landed: DataFrame, *, order: str = "seq") -> DataFrame:
    """Every track once, with its text or NULL, and a ``status`` column.

    The landed side keeps one text per key, so the left join adds no rows.  A
    key that holds many tracks is then one row on the right: AQE may split its
    tracks over several tasks, since a left join lets the left side be split.
    """
    keys = ["track_name", "artist"]
    texts = first_by_key(landed, keys, order=order).select(*keys, "lyrics")
    joined = tracks.join(texts, keys, "left")
    return joined.select(
        "track_id",
        *keys,
        "lyrics",
        F.when(F.col("lyrics").isNotNull(), "FOUND").otherwise("NOT FOUND").alias("status"),
    )


def coverage(tracks: DataFrame) -> DataFrame:
    """How many tracks have a text."""
    return tracks.agg(F.count("lyrics").alias("fetched"), F.count(F.lit(1)).alias("total"))
