"""What the operators share: the shared folder, written tables, crc and word helpers."""

from __future__ import annotations

import ctypes
import functools
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as characters and as a class of a pattern.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
BATCH_ROWS = 1_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only on a local master without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written to the shared folder and read again, so that its lineage ends there."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python a thousand at a time: a batch of texts stands in the memory of the
    executor and of its worker at once, more than once in each."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def crc_of_id(id_column: str) -> Column:
    """Unsigned crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary"))


def spread(*columns: str) -> Column:
    """A second join key. An aggregate by the join key has no shuffle of its own in a join, and
    AQE splits a hot key only where both sides have one; joining on this too gives it one."""
    return F.xxhash64(*columns)


def ship(module: str) -> None:
    """Send a module's functions to the workers by value, so that they need not have it."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def give_back() -> None:
    """Memory a worker has freed goes back to the system. Workers outlive a stage, and what they were given
    at most would else stand beside that of the next stages for as long."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(work):
    """A worker's function on batches that gives memory back when its task begins, and when it ends."""

    @functools.wraps(work)
    def run(batches):
        give_back()
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


ship(__name__)
