"""Places, running values and pages in an order, where no task sees more than a range of the rows.

Rows are sorted into ranges of their order by a shuffle and written once with the number of their
range; what each range holds is then summed up in a small table (a row for each range, or for each
range and key in it), and the sums of the ranges before are added to what a range counts by itself. One
key may own any share of the rows: its rows lie in as many ranges as it takes. Rows that are equal in
the whole order are told apart by ``tie``, so give the order a unique last column, or aggregate first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordercash.plans.joins import mix
from ordercash.session import scratch_dir

RANGE = "_range"


def ranges(df: DataFrame, order: Sequence[Column], ranges: int | None = None) -> DataFrame:
    """``df`` written in ranges of the order, with their number, ascending, as ``_range``.

    ``ranges`` is left to Spark (shuffle partitions, merged by size) unless it is given.
    """
    dealt = df.repartitionByRange(*order) if ranges is None else df.repartitionByRange(ranges, *order)
    path = scratch_dir(df.sparkSession, "ranges")
    numbered = dealt.withColumn(RANGE, F.spark_partition_id())
    numbered.write.partitionBy(RANGE).parquet(path)
    return df.sparkSession.read.schema(numbered.schema).parquet(path)


def _before(*by: str) -> Window:
    """The ranges ahead of one, of the same key."""
    return Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def numbered(
    df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), n: int | None = None
) -> DataFrame:
    """``df`` with ``place``, from 0, in the order, among the rows of the same ``by``."""
    keys = [F.col(c).asc_nulls_first() for c in by]
    rows = ranges(df, [*keys, *order], n)
    counts = rows.groupBy(RANGE, *by).agg(F.count("*").alias("_n"))
    starts = counts.select(
        F.col(RANGE).alias("_r"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)),
        F.coalesce(F.sum("_n").over(_before(*by)), F.lit(0)).alias("_start"),
    )
    own = Window.partitionBy(*by, RANGE).orderBy(*order)
    same = F.col(RANGE) == F.col("_r")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    placed = rows.withColumn("_at", F.row_number().over(own) - 1).join(starts, same)
    return placed.withColumn("place", (F.col("_start") + F.col("_at")).cast("long")).select(*df.columns, "place")


def deep_page(
    df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0, n: int | None = None
) -> DataFrame:
    """The same page as ``page``, at any depth: the ranges that don't hold it are only counted.

    The counts, a number for each range, are what comes to the driver.
    """
    rows = ranges(df, order, n)
    counts = rows.groupBy(RANGE).count().orderBy(RANGE).collect()
    held, start, first = [], 0, 0
    for r in counts:
        if start < offset + limit and start + r["count"] > offset:
            first = first if held else start
            held.append(r[RANGE])
        start += r["count"]
    near = rows.filter(F.col(RANGE).isin(held)).drop(RANGE)
    return near.orderBy(*order).offset(offset - first if held else 0).limit(limit)


def running(
    df: DataFrame, measure: str, order: str, by: Sequence[str] = (), n: int | None = None
) -> DataFrame:
    """Count, sum, least and most of ``measure`` so far for each (by, order) value, peers included, and ``peers``.

    One row for each value of ``by`` and ``order``, as under the default frame all rows of one value
    have the same running values; nulls of the order come last. Add them to rows by ``with_running``.
    """
    value = F.col(measure)
    peers = df.groupBy(*by, order).agg(
        F.count("*").alias("peers"), F.count(value).alias("_values"), F.sum(value).alias("_sum"),
        F.min(value).alias("_least"), F.max(value).alias("_most"),
    )
    place = [*(F.col(c).asc_nulls_first() for c in by), F.col(order).asc_nulls_last()]
    rows = ranges(peers, place, n)
    totals = rows.groupBy(RANGE, *by).agg(
        F.sum("peers").alias("peers"), F.count("*").alias("_distinct"), F.sum("_values").alias("_values"),
        F.sum("_sum").alias("_sum"), F.min("_least").alias("_least"), F.max("_most").alias("_most"),
    )
    ahead = _before(*by)
    whole = totals.select(
        F.col(RANGE).alias("_r"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)),
        *(F.sum(c).over(ahead).alias(f"_a{c}") for c in ("peers", "_distinct", "_values", "_sum")),
        F.min("_least").over(ahead).alias("_a_least"), F.max("_most").over(ahead).alias("_a_most"),
    )
    same = F.col(RANGE) == F.col("_r")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    here = Window.partitionBy(*by, RANGE).orderBy(F.col(order).asc_nulls_last())
    joined = rows.withColumn("_distinct", F.lit(1)).select(
        RANGE, *by, order, "peers",
        *(F.sum(c).over(here).alias(f"_h{c}") for c in ("peers", "_distinct", "_values", "_sum")),
        F.min("_least").over(here).alias("_h_least"), F.max("_most").over(here).alias("_h_most"),
    ).join(whole, same)

    def added(c: str) -> Column:
        # A sum of nulls alone is null.
        both = F.coalesce(f"_a{c}", F.lit(0)) + F.coalesce(f"_h{c}", F.lit(0))
        return F.when(F.col(f"_a{c}").isNotNull() | F.col(f"_h{c}").isNotNull(), both)

    return joined.select(
        *by, order, "peers", added("peers").alias("rows_so_far"), added("_distinct").alias("distinct_so_far"),
        added("_values").alias("values_so_far"), added("_sum").alias("sum_so_far"),
        F.least("_a_least", "_h_least").alias("least_so_far"), F.greatest("_a_most", "_h_most").alias("most_so_far"),
    )


def with_running(
    df: DataFrame, values: DataFrame, order: str, by: Sequence[str], columns: Mapping[str, Column]
) -> DataFrame:
    """Rows of ``df`` with the ``columns`` of the running values of their (by, order)."""
    keys = [*by, order]
    told = values.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), *(c.alias(k) for k, c in columns.items()))
    told = mix(told, *(f"_k{i}" for i in range(len(keys)))).withColumnRenamed("_mix", "_other")
    same = F.col("_mix") == F.col("_other")
    for i, c in enumerate(keys):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return mix(df, *keys).join(told, same).select(*df.columns, *columns)


def carried(
    df: DataFrame, order: Sequence[str], by: Sequence[str], value: Column, n: int | None = None
) -> DataFrame:
    """``df`` with ``carried``: the last ``value`` that is not null at or before each row of the same ``by``.

    The order is ascending, nulls first.
    """
    place = [F.col(c).asc_nulls_first() for c in order]
    rows = ranges(df.withColumn("_value", value), [*(F.col(c).asc_nulls_first() for c in by), *place], n)
    last = rows.filter(F.col("_value").isNotNull()).groupBy(RANGE, *by).agg(
        F.max_by("_value", F.struct(*order)).alias("_last")
    )
    # Ranges without a value of their own hand on that of the range before.
    held = rows.select(RANGE, *by).distinct()
    same = F.col(RANGE) == F.col("_r")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    last = held.join(last.select(F.col(RANGE).alias("_r"), *keys, "_last"), same, "left").select(RANGE, *by, "_last")
    ahead = last.select(
        F.col(RANGE).alias("_r"), *keys, F.last("_last", ignorenulls=True).over(_before(*by)).alias("_ahead")
    )
    own = Window.partitionBy(*by, RANGE).orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumn("_here", F.last("_value", ignorenulls=True).over(own))
    return here.join(ahead, same).select(*df.columns, F.coalesce("_here", "_ahead").alias("carried"))


def chunked(
    df: DataFrame, order: Sequence[Column], by: Sequence[str], item: str, size: int, n: int | None = None
) -> DataFrame:
    """Lists of ``item`` in the order, repeats kept, as (by, chunk, items): chunks of ``size``, the last shorter."""
    rows = numbered(df, order, by, n)
    cell = F.struct("place", F.col(item).alias("item"))
    return (
        rows.groupBy(*by, F.floor(F.col("place") / size).alias("chunk"))
        .agg(F.array_sort(F.collect_list(cell)).alias("cells"))
        .select(*by, "chunk", F.col("cells.item").alias("items"))
    )
