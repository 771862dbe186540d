"""Stage tables in the folder all executors share.

Stages are cut by writing a Parquet table: a later step then depends on files,
not on a long lineage, so a lost executor costs one task and never a rebuild.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
_temporary: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names; a temporary one, kept per application, only in local mode."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", None) or ""):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
    application = spark.conf.get("spark.app.id", "")
    if application not in _temporary:
        _temporary[application] = tempfile.mkdtemp(prefix="kindred-")
    return _temporary[application]


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/kindred/{name}-{uuid.uuid4().hex[:12]}"


def save_stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a stage table and read it back."""
    target = path or stage_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def broadcast_if_bounded(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """Mark ``df`` for broadcast only after counting that it is small.

    Counting stops at the bound.  The flag tells the caller which join to
    build, since the other case needs a shuffle that survives hot keys.
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df) if small else df), small
