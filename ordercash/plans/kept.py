"""Rows written once to the shared folder, after which the shuffles that led to them are removed.

Shuffle files stay on disk until the query that made them ends, beside those of every later step. What is
kept here is column-wise and compressed, and takes a fraction of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ordercash.session import scratch_dir

#: Shuffle files go when the statement that made them ends; a kept file is read by tasks of its own, as its
#: rows take many times its bytes when they are exploded and sorted.
SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "8m",
}


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    try:
        for key, value in SETTINGS.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def kept(name: str, *dfs: DataFrame) -> DataFrame:
    """The rows of all ``dfs``, which have the same columns, written one after the other and read again."""
    spark, paths = dfs[0].sparkSession, []
    for df in dfs:
        paths.append(scratch_dir(spark, name))
        with _settings(spark):
            df.write.option("compression", "zstd").parquet(paths[-1])
    return spark.read.schema(dfs[0].schema).parquet(*paths)
