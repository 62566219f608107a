"""Two-pass external shuffle into shards.

Pass one scatters records by seeded hashes into buckets small enough for a task's memory; pass two
draws a Fisher-Yates shuffle of every bucket (Spark's ``shuffle`` function) and writes it. A shard
is a run of buckets. Which shard a record goes to depends on its id and the number of shards only:
every shard draws a seeded hash of the id and the largest draw wins (rendezvous hashing), so that
one more shard takes records only into itself.

Nulls: a null id is an id like any other; a null text has no bytes. Empty table: no rows. Repeated
rows stay apart: each gets its own slot. Rows of one id, however many, fall in one shard, as they
must, but are spread over its buckets by their text and their place in the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ordercash.llm.common import fresh_path, written


def rendezvous(id_column: Column, shards: int, seed: int) -> Column:
    """The shard whose seeded hash of the id is largest; of equal hashes the lowest shard."""
    draws = [
        F.struct(F.xxhash64(F.lit(seed), F.lit(i), id_column).alias("draw"), F.lit(-i).alias("no"))
        for i in range(shards)
    ]
    return -(F.greatest(*draws) if shards > 1 else draws[0])["no"]


def sized_text(text: Column) -> list[Column]:
    """``size`` and ``text_crc32`` of a text."""
    return [
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    ]


def shuffled(
    docs: DataFrame,
    shards: int = 16,
    id_column: str = "doc_id",
    text_column: str = "text",
    seed: int = 17,
    bucket_bytes: int = 32 << 20,
    keep: list[str] | None = None,
) -> DataFrame:
    """Every record with ``shard``, ``slot`` (gapless from 0 within a shard), ``bucket``, ``size``,
    ``text_crc32`` and ``grown_shard``, the shard it has when there is one more.

    ``keep`` names the columns of ``docs`` that come along; all of them if None. Their names may
    be any: they travel inside a struct and come back as they were, in a struct ``record``.
    """
    text = F.col(text_column)
    record = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    sized = docs.select(
        record.alias("record"),
        F.col(id_column).alias("key"),
        *sized_text(text),
    ).withColumns({
        "shard": rendezvous(F.col("key"), shards, seed),
        "grown_shard": rendezvous(F.col("key"), shards + 1, seed),
        # Only the place in the bucket rests on the row's place in the input.
        "row": F.monotonically_increasing_id(),
    })
    sized = written(sized, "sized", compression="zstd")
    # What a row weighs beside its text, or without it.
    carried = F.lit(256) + (F.col("size") if keep is None else F.lit(0))
    # A salt of a thousand parts a shard keeps the sums small; its size does not grow.
    total = sized.groupBy("shard").agg(F.sum(carried).alias("bytes")).agg(F.max("bytes")).first()[0]
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    hashed = F.xxhash64(F.lit(seed + 1), "key", "text_crc32", "row")
    scattered = sized.withColumn("bucket", F.pmod(hashed, F.lit(buckets)).cast("int"))
    # Fisher-Yates within a bucket; its rows come in one order first, whatever order they arrive in.
    rows = F.array_sort(F.collect_list(F.struct("row", "record", "key", "size", "text_crc32", "grown_shard")))
    drawn = scattered.groupBy("shard", "bucket").agg(rows.alias("rows"))
    drawn = drawn.withColumn("rows", F.shuffle("rows", F.lit(seed)))
    counts = scattered.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    return (
        drawn.join(starts, ["shard", "bucket"])
        .select("shard", "bucket", "start", F.posexplode("rows").alias("place", "r"))
        .select(
            "r.record", "r.key", "r.size", "r.text_crc32", "shard", "bucket", "r.grown_shard",
            (F.col("start") + F.col("place")).alias("slot"),
        )
    )


def write_shards(docs: DataFrame, path: str | None = None, shards: int = 16, **options) -> str:
    """Write the shards as Parquet, one folder a shard, each file's rows in shuffled order."""
    path = path or fresh_path(docs.sparkSession, "shards")
    placed = shuffled(docs, shards, **options)
    (
        # A bucket's rows lie in one task already; they are shuffled over the network once.
        placed.sortWithinPartitions("shard", "bucket", "slot")
        .select("record", "slot", "shard", "bucket")
        .write.partitionBy("shard", "bucket")
        .parquet(path)
    )
    return path


def read_shards(
    docs: DataFrame,
    path: str,
    shards: int = 16,
    id_column: str = "doc_id",
    text_column: str = "text",
    seed: int = 17,
) -> DataFrame:
    """The shards of ``docs`` at ``path``, with ``key``, ``size``, ``text_crc32`` and ``grown_shard``
    of the records read."""
    schema = T.StructType([
        T.StructField("record", docs.schema), T.StructField("slot", T.LongType()),
        T.StructField("shard", T.IntegerType()), T.StructField("bucket", T.IntegerType()),
    ])
    key, text = F.col("record")[id_column], F.col("record")[text_column]
    return docs.sparkSession.read.schema(schema).parquet(path).select(
        "record", key.alias("key"), *sized_text(text), "shard", "bucket",
        rendezvous(key, shards + 1, seed).alias("grown_shard"), "slot",
    )
