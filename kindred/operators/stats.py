"""Descriptive statistics, histograms and score summaries as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, min, exact quartiles and max.

    Meant for integer measures such as token counts: the quartile state holds
    one entry per distinct value, which the length limits bound.
    """
    quart = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    row = df.agg(
        F.count(column).alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).cast("double").alias("min"),
        quart.alias("_q"),
        F.max(column).cast("double").alias("max"),
    )
    quartiles = [F.col("_q")[i].alias(n) for i, n in enumerate(["q25", "q50", "q75"])]
    return row.select("count", "mean", "std", "min", *quartiles, "max")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins over the column's range, empty bins included.

    The last bin is closed; a constant column gets a range of width one around
    its value.  Rows: ``bin`` (from 1), ``low``, ``high``, ``count``.
    """
    span = df.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    span = span.select(
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    )
    # Both sides read one aggregate row, so the row is attached to the bins and
    # to the values as a scalar and never joined to the data.
    limits = span.select(F.struct("_lo", "_hi").alias("_span")).scalar()
    placed = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_v"), limits.alias("_s"))
    bucket = F.least(F.width_bucket("_v", F.col("_s._lo"), F.col("_s._hi"), F.lit(bins)), F.lit(bins))
    counts = placed.select(bucket.cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    step = (F.col("_hi") - F.col("_lo")) / bins
    frame = span.where("_lo is not null").select(
        "_lo", step.alias("_step"), F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")
    )
    return frame.join(counts, "bin", "left").select(
        "bin",
        (F.col("_lo") + (F.col("bin") - 1) * F.col("_step")).alias("low"),
        (F.col("_lo") + F.col("bin") * F.col("_step")).alias("high"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
    )


THRESHOLDS = (0.1, 0.3, 0.5, 0.9)


def score_summary(df: DataFrame, column: str = "similarity", thresholds=THRESHOLDS) -> DataFrame:
    """Mean, median, max and the share of scores strictly above each threshold.

    Scores are compared at six places, so the exact median keeps two million
    distinct values at most however many pairs there are.
    """
    score = F.round(column, 6)
    return df.agg(
        F.count(column).alias("pairs"),
        F.avg(column).alias("mean"),
        F.median(score).alias("median"),
        F.max(column).alias("max"),
        *[
            F.avg((score > t).cast("double")).alias(f"above_{str(t).replace('.', '_')}")
            for t in thresholds
        ],
    )
