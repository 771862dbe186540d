"""Lemmatise tokens through a lookup table the user supplies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.sources.shared import broadcast_if_bounded, save_stage

BROADCAST_LEMMAS = 500_000
SALTS = 32


def lemmatize(
    df: DataFrame, lemmas: DataFrame | None, *, tokens: str = "tokens", key: str = "song_id"
) -> DataFrame:
    """Replace each token by its lemma where ``lemmas(surface, lemma)`` has one.

    Without a table this is the identity.  Songs are spread by key before
    their tokens are exploded, so putting the tokens back in order needs no
    second shuffle when the table is small enough to broadcast.  A larger table
    is joined on (token, salt), which splits words that occur everywhere.
    """
    if lemmas is None:
        return df
    table = lemmas.groupBy("surface").agg(F.min("lemma").alias("lemma"))
    table, small = broadcast_if_bounded(table, BROADCAST_LEMMAS)
    # Tokens and the other columns both start here: a stage spares what came before a second run.
    spread = save_stage(df, "lemma-input").repartition(key)
    words = spread.select(key, F.posexplode(tokens).alias("pos", "token"))
    if small:
        found = words.join(table, F.col("token") == F.col("surface"), "left")
    else:
        salted = table.withColumnRenamed("surface", "token").withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        )
        spread_words = words.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
        found = spread_words.join(salted, ["token", "_salt"], "left")
    back = found.groupBy(key).agg(
        F.sort_array(
            F.collect_list(F.struct("pos", F.coalesce("lemma", "token").alias("token")))
        ).alias("_placed")
    )
    rest = spread.withColumn("_had", F.col(tokens).isNotNull()).drop(tokens)
    joined = rest.join(back, key, "left")
    restored = F.when(F.col("_had"), F.coalesce(F.col("_placed.token"), F.array().cast("array<string>")))
    return joined.withColumn(tokens, restored).select(*df.columns)
