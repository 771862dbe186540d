"""Keep the first row of each key, and set operations on song lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first(df: DataFrame, keys: list, order: str) -> DataFrame:
    """Row number 1 per key.

    The planner puts a group limit before the shuffle, so each map task sends
    one row per key at most: a key that holds a third of the table arrives as
    one row per map task, not as one huge group.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def first_by_key(df: DataFrame, keys: list[str], *, order: str = "seq") -> DataFrame:
    """First row per key in ``order``; NULLs form one group, case matters."""
    return _first(df, keys, order)


def text_key(col: Column | str) -> Column:
    """Fixed-length stand-in for a long text."""
    return F.sha2(F.col(col) if isinstance(col, str) else col, 256)


def first_by_text(df: DataFrame, text: str, *, order: str = "seq") -> DataFrame:
    """First row per exact text; the text travels as payload, not as sort key."""
    return _first(df.withColumn("_key", text_key(text)), ["_key"], order).drop("_key")


SONG = ["track_name", "artist"]


def song_set(df: DataFrame) -> DataFrame:
    return df.select(*SONG).distinct()


def shared_songs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Songs on both lists; a NULL artist equals a NULL artist."""
    return a.select(*SONG).intersect(b.select(*SONG))


def all_songs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Songs on either list."""
    return a.select(*SONG).union(b.select(*SONG)).distinct()


def only_in_first(a: DataFrame, b: DataFrame) -> DataFrame:
    """Songs on the first list and not on the second; a NULL artist equals a NULL artist."""
    return a.select(*SONG).subtract(b.select(*SONG))
