"""Session settings that suit the size of the input."""

from __future__ import annotations

PARTITION_BYTES = 128 << 20


def settings(input_bytes: int, cores: int) -> dict[str, str]:
    """Spark settings for a job over ``input_bytes`` on ``cores`` cores.

    Shuffles start with partitions of about 128 MB, never fewer than two per
    core, and AQE merges those that turn out small and splits those that turn
    out hot.
    """
    partitions = max(2 * cores, -(-input_bytes // PARTITION_BYTES))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(PARTITION_BYTES),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
