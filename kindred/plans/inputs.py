"""Song-shaped inputs derived from the sample tables.

Every derivation keeps whole tables and whole texts: phrases are added to some
texts so that each rule has something to find, and no row is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a sample table that a task takes: what it sorts and folds fits its memory whatever the table's size.
TASK_ROWS = 8_192
#: Files whose largest part has no more than so many times TASK_ROWS are read as they lie.
SPREAD = 8


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A sample table, spread by its first column over the cores, or over more tasks if it is large.

    Some sample files hold one row group each, which only one task can read; a table whose files are spread already
    is not shuffled, so the operators themselves never reshuffle their input.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    parts = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"))
    rows, largest = parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if 0 < largest <= SPREAD * TASK_ROWS and largest * cores <= 2 * rows:
        return df
    return df.repartition(max(cores, -(-rows // TASK_ROWS)), df.columns[0])


def _song(text) -> list:
    return [
        F.col("doc_id").alias("song_id"),
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("T"), F.expr("cast(doc_id div 40 as string)")).alias("track_name"),
        F.col("source").alias("artist"),
        text.alias("lyrics"),
    ]


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as songs; a title is shared by many artists and each
    (title, artist) pair by two documents."""
    return read_table(spark, sf_dir, "documents").select(*_song(F.col("text")))


def marked_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Songs with footers, editorial phrases and metadata phrases added, plus
    songs without an artist (benchmark) and tracks without a text (labels)."""

    def when(n: int, text: str):
        return F.when(F.col("doc_id") % n == 0, text).otherwise("")

    lyrics = F.concat(
        when(19, "embed x\n"),
        F.col("text"),
        when(11, " produced by x"),
        when(13, " remaster"),
        when(17, " label:x"),
        when(37, " label: x"),
        when(7, "\n12EmbedShare"),
    )
    documents = read_table(spark, sf_dir, "documents").select(*_song(lyrics))
    nobody = read_table(spark, sf_dir, "benchmark").select(
        (-1 - F.col("item_id")).alias("song_id"),
        (-1 - F.col("item_id")).alias("seq"),
        F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("track_name"),
        F.lit(None).cast("string").alias("artist"),
        F.col("text").alias("lyrics"),
    )
    unfetched = read_table(spark, sf_dir, "labels").select(
        (-1_000_000_000_000 - F.col("doc_id")).alias("song_id"),
        (-1_000_000_000_000 - F.col("doc_id")).alias("seq"),
        F.concat(F.lit("L"), F.col("doc_id").cast("string")).alias("track_name"),
        F.lit("nobody").alias("artist"),
        F.lit(None).cast("string").alias("lyrics"),
    )
    return documents.unionByName(nobody).unionByName(unfetched)


def headed_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Songs with section headers: a verse first, a chorus at each line end,
    a hook after each comma and blank."""
    text = F.replace("text", F.lit("\n"), F.lit("\n[Chorus]\n"))
    text = F.replace(text, F.lit(", "), F.lit(",\n [Hook 2] skipped\n"))
    lyrics = F.concat(F.lit("[Verse 1]\n"), text)
    return read_table(spark, sf_dir, "documents").select(*_song(lyrics))


def dense_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("song_id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("vector"), "label"
    )


def artist_seeds(corpus: DataFrame) -> DataFrame:
    """One seed per artist (the artist's first song), a title without artist
    and a title nobody has."""
    first = corpus.groupBy("artist").agg(F.min(F.struct("seq", "track_name")).alias("_first"))
    named = first.select(
        F.col("artist").alias("seed_id"), F.lower("_first.track_name").alias("seed_title"), F.upper("artist").alias("seed_artist")
    )
    extra = corpus.sparkSession.createDataFrame(
        [("any artist", "t1", ""), ("nobody", "No Such Title", None)], named.schema
    )
    return named.unionByName(extra)


def library_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested library pages of 50 documents and one empty page.

    Every 23rd item has lost its track and every 29th its artists."""
    d = read_table(spark, sf_dir, "documents")
    artists = F.when(F.col("doc_id") % 29 == 0, F.array().cast("array<struct<name:string,id:string>>")).otherwise(
        F.array(
            F.struct(F.col("source").alias("name"), F.concat(F.lit("id-"), "source").alias("id")),
            F.struct(F.col("lang").alias("name"), F.lit("second").alias("id")),
        )
    )
    track = F.struct(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit("T"), F.expr("cast(doc_id div 40 as string)")).alias("name"),
        artists.alias("artists"),
        F.struct(F.concat(F.lit("album "), "lang").alias("name"), F.lit("2001-02").alias("release_date")).alias("album"),
    )
    item = F.struct(
        F.concat(F.lit("added "), F.col("n_chars").cast("string")).alias("added_at"),
        F.when(F.col("doc_id") % 23 != 0, track).alias("track"),
    )
    # A page holds 50 consecutive ids, so the group is bounded by its key.
    pages = d.groupBy(F.expr("doc_id div 50").alias("_page")).agg(F.collect_list(item).alias("items"))
    empty = spark.createDataFrame([([],)], pages.select("items").schema)
    return pages.select("items").unionByName(empty)
