"""From raw songs to clean corpora: full texts and chorus-only texts.

Input: ``song_id, seq, track_name, artist, lyrics``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import text as tx
from kindred.functions import wordlists as wl
from kindred.functions.text import compute_once
from kindred.operators.dedupe import first_by_key, first_by_text, text_key
from kindred.operators.filters import drop_blocklisted, drop_missing_text
from kindred.operators.lemmas import lemmatize


def tokenized(df: DataFrame, text: str, *, across_lines: bool = False, lemmas: DataFrame | None = None) -> DataFrame:
    """Add ``tokens`` and ``token_count`` of a text column."""
    return _tokens_of(compute_once(df, _low=F.lower(text)), across_lines, lemmas).drop("_low")


def _tokens_of(df: DataFrame, across_lines: bool, lemmas: DataFrame | None) -> DataFrame:
    done = compute_once(df, tokens=tx.clean_tokens("_low", across_lines=across_lines))
    return lemmatize(done, lemmas).withColumn("token_count", F.size("tokens"))


def clean_corpus(
    songs: DataFrame,
    *,
    prose_gate: bool = False,
    lemmas: DataFrame | None = None,
    min_tokens: int = wl.MIN_TOKENS_FULL,
    max_tokens: int = wl.MAX_TOKENS_FULL,
    distinct_text: bool = True,
) -> DataFrame:
    """Full texts: drop unusable rows, clean, bound the length, drop copies.

    Adds ``tokens``, ``token_count`` and ``processed_lyrics``.  The raw text
    crosses the one shuffle (copies) only if the caller selects it.
    """
    kept = drop_missing_text(drop_blocklisted(songs))
    kept = compute_once(kept, _low=F.lower("lyrics")).where(~tx.has_narrow_metadata("lyrics", "_low"))
    if prose_gate:
        kept = kept.where(tx.is_likely_lyrics("lyrics", "_low"))
    kept = _tokens_of(kept, False, lemmas).drop("_low").where(F.col("token_count").between(min_tokens, max_tokens))
    kept = kept.withColumn("processed_lyrics", tx.join_tokens("tokens"))
    if not distinct_text:
        return kept
    # The tokens travel within the text.
    packed = kept.withColumnRenamed("processed_lyrics", "_text").withColumn("_odd", tx.odd_tokens("tokens")).drop("tokens")
    few = first_by_text(packed, "_text").withColumn("tokens", tx.tokens_of("_text", "_odd"))
    return few.withColumnRenamed("_text", "processed_lyrics").select(*kept.columns)


def clean_report(songs: DataFrame, *, prose_gate: bool = False, lemmas: DataFrame | None = None) -> DataFrame:
    """Rows kept and dropped, by the first rule that failed.

    One pass: rows are folded per (reason, text) before the shuffle, so many
    copies of one text are one group of one row per map task.
    """
    blocked = songs.sparkSession.createDataFrame(wl.BLOCKLIST, "_a string, _t string")
    listed = (F.lower("artist") == F.col("_a")) & (F.lower("track_name") == F.col("_t"))
    raw = F.when(F.col("_a").isNotNull(), "blocklisted").when(F.col("lyrics").isNull(), "no text")
    raw = raw.when(tx.has_narrow_metadata("lyrics", "_low"), "metadata")
    if prose_gate:
        raw = raw.when(~tx.is_likely_lyrics("lyrics", "_low"), "prose")
    # The list is a constant of this module, so its size is known.
    flagged = compute_once(songs.join(F.broadcast(blocked), listed, "left"), _low=F.lower("lyrics"))
    flagged = compute_once(flagged, _raw=raw)
    flagged = compute_once(flagged, tokens=F.when(F.col("_raw").isNull(), tx.clean_tokens("_low")))
    flagged = lemmatize(flagged, lemmas)
    n = F.size("tokens")
    reason = (
        F.when(F.col("_raw").isNotNull(), F.col("_raw"))
        .when(n == 0, "empty")
        .when(n < wl.SHORT_TOKENS_FULL, "short")
        .when(n > wl.MAX_TOKENS_FULL, "long")
    )
    rows = flagged.select(reason.alias("_reason"), n.alias("_n"), tx.join_tokens("tokens").alias("_text"))
    per_text = (
        rows.groupBy("_reason", F.when(F.col("_reason").isNull(), text_key("_text")).alias("_key"))
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_n").alias("_n"))
        .withColumn(
            "_first",
            F.when(F.col("_reason").isNotNull(), F.col("_reason"))
            .when(F.col("_n") < wl.MIN_TOKENS_FULL, "short")
            .otherwise("kept"),
        )
    )
    whole = F.col("_reason").isNotNull()
    first = F.struct(F.col("_first").alias("outcome"), F.when(whole, F.col("_rows")).otherwise(1).alias("rows"))
    copies = F.struct(
        F.lit("duplicate").alias("outcome"), F.when(whole, F.lit(0)).otherwise(F.col("_rows") - 1).alias("rows")
    )
    return (
        per_text.select(F.inline(F.array(first, copies)))
        .groupBy("outcome")
        .agg(F.sum("rows").alias("rows"))
        .where("rows > 0")
    )


def _chorus_texts(songs: DataFrame) -> DataFrame:
    """``chorus_text``, and in ``_raw`` the first failing rule of the whole text."""
    raw = F.when(tx.has_wide_metadata("lyrics", "_low"), "metadata").when(
        ~tx.is_likely_lyrics("lyrics", "_low"), "prose"
    )
    df = compute_once(drop_missing_text(songs), _low=F.lower("lyrics"))
    df = compute_once(df, _raw=raw).drop("_low")
    df = compute_once(df, _blocks=F.when(F.col("_raw").isNull(), tx.section_blocks("lyrics")))
    return compute_once(df, chorus_text=tx.chorus_of_blocks("_blocks")).drop("_blocks")


def _flag_chorus(texts: DataFrame, lemmas: DataFrame | None) -> DataFrame:
    """Tokens of the chorus text and the first failing rule, all inside the row."""
    df = tokenized(texts, "chorus_text", across_lines=True, lemmas=lemmas)
    reason = (
        F.when(F.col("_raw").isNotNull(), F.col("_raw"))
        .when(F.col("chorus_text").isNull(), "no chorus")
        .when(F.col("token_count") == 0, "empty")
        .when(F.col("token_count") < wl.MIN_TOKENS_CHORUS, "short")
    )
    return df.withColumn("drop_reason", reason).drop("_raw")


def chorus_corpus(songs: DataFrame, *, lemmas: DataFrame | None = None) -> DataFrame:
    """Chorus-only texts.

    The first row of each (title, artist) decides, even if a later rule drops
    it.  The chorus is cut out before the shuffle all the same, so what
    travels is its text and not the whole one; its tokens follow behind.
    """
    flagged = _flag_chorus(first_by_key(_chorus_texts(songs), ["track_name", "artist"]), lemmas)
    kept = flagged.where("drop_reason is null").drop("drop_reason")
    return kept.withColumn("processed_chorus", tx.join_tokens("tokens"))


def chorus_report(songs: DataFrame, *, lemmas: DataFrame | None = None) -> DataFrame:
    """Rows with a text, kept and dropped, by the first rule that failed."""
    flagged = _flag_chorus(_chorus_texts(songs), lemmas).withColumn("_outcome", F.coalesce("drop_reason", F.lit("kept")))
    per_key = flagged.groupBy("track_name", "artist").agg(
        F.count(F.lit(1)).alias("_rows"), F.min(F.struct("seq", "_outcome")).alias("_first")
    )
    first = F.struct(F.col("_first._outcome").alias("outcome"), F.lit(1).cast("long").alias("rows"))
    copies = F.struct(F.lit("duplicate").alias("outcome"), (F.col("_rows") - 1).alias("rows"))
    return (
        per_key.select(F.inline(F.array(first, copies)))
        .groupBy("outcome")
        .agg(F.sum("rows").alias("rows"))
        .where("rows > 0")
    )
