"""Schemas and CSV/Parquet access for song tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


TRACK_METADATA = _strings("track_id", "track_name", "artist", "artist_id", "album", "release_date", "added_at")
LYRICS = _strings("track_id", "track_name", "artist", "lyrics")
LYRICS_CLEAN = T.StructType(
    LYRICS.fields
    + [T.StructField("processed_lyrics", T.StringType()), T.StructField("token_count", T.IntegerType())]
)
CHORUS_CLEAN = T.StructType(
    LYRICS.fields
    + [
        T.StructField("chorus_text", T.StringType()),
        T.StructField("processed_chorus", T.StringType()),
        T.StructField("token_count", T.IntegerType()),
    ]
)

# Values hold line ends and doubled quotes, and their outer blanks count.
_CSV = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a CSV table with a fixed schema; texts such as ``None`` stay texts.

    A multi-line CSV file cannot be split, so one file is one task: land large
    tables as many files and keep Parquet between stages.
    """
    return spark.read.schema(schema).options(multiLine=True, **_CSV).csv(path)


def write_csv_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(**_CSV).csv(path)


def with_sequence(df: DataFrame, *order_by: str, name: str = "seq") -> DataFrame:
    """Number rows in a total order; "first" means the lowest number.

    Equal keys keep their input order; that last key also lets the range
    shuffle split a value that a large part of the table shares.  The number
    carries the range in its upper bits, so it increases in order without a
    single-task pass.  Write the result once and read it back before using it.
    Without keys rows are numbered as they are read, and nothing is sorted.
    """
    if not order_by:
        return df.withColumn(name, F.monotonically_increasing_id())
    placed = df.withColumn("_row", F.monotonically_increasing_id())
    return placed.orderBy(*order_by, "_row").withColumn(name, F.monotonically_increasing_id()).drop("_row")


def table_shape(df: DataFrame, *distinct: str) -> DataFrame:
    """One row with the row count and a distinct count per named column."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_distinct(c).alias(f"distinct_{c}") for c in distinct],
    )
