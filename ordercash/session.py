"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where a later aggregation then needs its own shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows take many times the memory of their shuffled bytes, and more where they are exploded or sorted.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


def configure(spark: SparkSession, shuffle_partitions: int | None = None) -> SparkSession:
    """Apply the settings; ``shuffle_partitions`` is the number AQE starts from and coalesces.

    Give it for large data: about the bytes of the largest shuffle over 128 MB.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if shuffle_partitions is not None:
        initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
        spark.conf.set(initial, str(shuffle_partitions))
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``.

    Only on a local master without that setting, as in tests, is a temporary folder taken.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local"):
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    if not root:
        raise ValueError("spark.checkpoint.dir must name a folder all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
