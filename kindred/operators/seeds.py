"""Find seed songs by title and optional artist."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def _called(songs: DataFrame, title: str, artist: str | None) -> DataFrame:
    """Songs with this title and, unless it is empty, this artist, ignoring case."""
    same = F.lower("track_name") == F.lower(F.lit(title))
    return songs.where(same & (F.lower("artist") == F.lower(F.lit(artist)))) if artist else songs.where(same)


def find_song(songs: DataFrame, title: str, artist: str | None = None, *, order: str = "seq") -> Row:
    """First song with this title (and artist), ignoring case; ``ValueError`` when there is none."""
    first = _called(songs, title, artist).orderBy(order).first()
    if first is None:
        raise ValueError(f"no song is called {title!r}" + (f" by {artist!r}" if artist else ""))
    return first


def match_seeds(songs: DataFrame, seeds: DataFrame, *, order: str = "seq") -> DataFrame:
    """Resolve many seeds at once.

    ``seeds`` holds ``seed_id, seed_title, seed_artist``.  Every seed comes
    back once with ``found`` and, when found, ``song_id`` and ``seq`` of the
    first match.  Songs are folded to the first of each title, and of each
    title and artist, before they meet the seeds, so a title that many songs
    share is one row.
    """
    wanted = seeds.select("seed_id", "seed_title", F.nullif("seed_artist", F.lit("")).alias("seed_artist"))
    keyed = songs.select(
        F.lower("track_name").alias("_title"), F.lower("artist").alias("_artist"), F.struct(order, "song_id").alias("_song")
    )
    parts = []
    for given, keys in ((F.col("seed_artist").isNotNull(), ["_title", "_artist"]), (F.col("seed_artist").isNull(), ["_title"])):
        first = keyed.groupBy(*keys).agg(F.min("_song").alias("_song"))
        asked = wanted.where(given).withColumns({"_title": F.lower("seed_title"), "_artist": F.lower("seed_artist")})
        parts.append(asked.join(first, keys, "left").select(*wanted.columns, "_song.song_id", f"_song.{order}"))
    return parts[0].unionByName(parts[1]).withColumn("found", F.col("song_id").isNotNull())


def inspect_song(
    songs: DataFrame, title: str, artist: str | None = None, *, fields: dict[str, int], order: str = "seq"
) -> DataFrame:
    """One song with the first characters of its long texts.

    ``fields`` maps a text column to the number of characters shown.
    """
    shown = [F.substring(c, 1, n).alias(c) for c, n in fields.items()]
    return _called(songs, title, artist).orderBy(order).limit(1).select("track_name", "artist", "token_count", *shown)
