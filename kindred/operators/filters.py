"""Row filters of the cleaning pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import wordlists as wl
from kindred.sources.shared import broadcast_if_bounded

BROADCAST_BLOCKLIST = 500_000


def drop_blocklisted(df: DataFrame, pairs: list[tuple[str, str]] | DataFrame = wl.BLOCKLIST) -> DataFrame:
    """Remove listed (artist, title) pairs, ignoring case.

    An anti join keeps rows whose artist or title is NULL; a negated
    conjunction would lose them.
    """
    if isinstance(pairs, DataFrame):
        listed = pairs
    else:
        listed = df.sparkSession.createDataFrame(pairs, "artist string, track_name string")
    blocked = listed.select(F.lower("artist").alias("_b_artist"), F.lower("track_name").alias("_b_title"))
    blocked, _ = broadcast_if_bounded(blocked, BROADCAST_BLOCKLIST)
    same = (F.lower("artist") == F.col("_b_artist")) & (F.lower("track_name") == F.col("_b_title"))
    return df.join(blocked, same, "left_anti")


def drop_missing_text(df: DataFrame, text: str = "lyrics") -> DataFrame:
    return df.na.drop(subset=[text])
