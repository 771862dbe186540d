"""Library pages: nested JSON to one row per track."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIBRARY_PAGE = T.StructType().add(
    "items",
    T.ArrayType(
        T.StructType()
        .add("added_at", T.StringType())
        .add(
            "track",
            T.StructType()
            .add("id", T.StringType())
            .add("name", T.StringType())
            .add("artists", T.ArrayType(T.StructType().add("name", T.StringType()).add("id", T.StringType())))
            .add("album", T.StructType().add("name", T.StringType()).add("release_date", T.StringType())),
        )
    ),
)


def read_library_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages, one JSON object per line; an empty page adds no rows."""
    return spark.read.schema(LIBRARY_PAGE).json(path)


def library_items(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode("items").alias("item"))


def flatten_tracks(pages: DataFrame) -> DataFrame:
    """Track rows; items without a track are skipped, the first artist counts.

    A track without artists keeps its row with NULL artist fields.
    """
    first_artist = F.get("item.track.artists", F.lit(0))
    return (
        library_items(pages)
        .where("item.track is not null")
        .select(
            F.col("item.track.id").alias("track_id"),
            F.col("item.track.name").alias("track_name"),
            first_artist["name"].alias("artist"),
            first_artist["id"].alias("artist_id"),
            F.col("item.track.album.name").alias("album"),
            F.col("item.track.album.release_date").alias("release_date"),
            F.col("item.added_at").alias("added_at"),
        )
    )
