"""Join shapes that hold up when one key owns a large share of the rows.

At run time AQE splits a skewed partition of either side of an inner join, and of the
preserved side of an outer, semi or anti join. It cannot split the other side of a left
join, nor the probed side of a semi or anti join, nor any join in which a side is an aggregate
by the join key. The helpers below cover those: ``left_join_many`` is an inner join and the rows
without a match, ``having_some`` and ``having_no`` probe distinct keys, and ``join_totals`` joins an
aggregate in a way that AQE can split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def left_join_many(left: DataFrame, many: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """``left LEFT JOIN many USING (on)`` where a key may have any number of rows on either side.

    An inner join, of which AQE splits both sides, and the rows of ``left`` without a match, found by an
    outer join with the distinct keys, of which it splits the left side. (An anti join would be pushed into
    a union on the left, and lose its keys where they are null for a whole branch.) Both read the same shuffle of ``left``: keys are compared by
    ``<=>``, as an equality has Spark drop null keys ahead of the inner join's shuffle alone, which
    makes two of it. Null keys of ``many`` go first, so that they match nothing.
    """
    keys = [on] if isinstance(on, str) else list(on)
    rows, there = mix(left, *keys), mix(many.dropna(subset=keys), *keys).withColumnRenamed("_mix", "_other")
    same = F.col("_mix") == F.col("_other")
    for i, c in enumerate(keys):
        there = there.withColumnRenamed(c, f"_key{i}")
        same &= F.col(c).eqNullSafe(F.col(f"_key{i}"))
    found = ["_other", *(f"_key{i}" for i in range(len(keys)))]
    matched = rows.join(there, same).drop(*found)
    alone = rows.join(there.select(*found).distinct(), same, "left").filter("_other IS NULL").drop(*found)
    others = [c for c in (*left.columns, *many.columns) if c not in keys]
    return matched.unionByName(alone, allowMissingColumns=True).select(*[F.col(f"`{c}`") for c in (*keys, *others)])


def left_join_one(left: DataFrame, one: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """``left LEFT JOIN one`` where ``one`` is a table unique by ``on``."""
    return left.join(one, on, "left")


def mix(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with a second join key ``_mix``, a hash of ``keys``.

    AQE splits a skewed join only where both sides come straight out of a shuffle. An
    aggregate by the join key is joined where it lies, without one, so a hot key on the other
    side stays in one task. Joining on the key and ``_mix`` makes the planner shuffle the
    aggregate, which has one row per key, and leaves the other side splittable.
    """
    return df.withColumn("_mix", F.xxhash64(*keys))


def join_totals(left: DataFrame, totals: DataFrame, on: str, how: str = "left") -> DataFrame:
    """``left JOIN totals`` where ``totals`` is an aggregate by ``on`` and ``left`` is skewed."""
    return mix(left, on).join(mix(totals, on), [on, "_mix"], how).drop("_mix")


def having_some(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``other``."""
    return join_totals(df, other.select(on).distinct(), on, "left_semi")


def pick(df: DataFrame, column: str, wanted: str | DataFrame) -> DataFrame:
    """Rows of one key, or of every key in a DataFrame that has the column."""
    if isinstance(wanted, str):
        return df.filter(F.col(column) == wanted)
    return having_some(df, wanted, column)


def having_no(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``other``; a null key never occurs."""
    return join_totals(df, other.select(on).distinct(), on, "left_anti")
