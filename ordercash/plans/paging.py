"""Ordering and paging with the null order of the source database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest_first(column: str, *key: str) -> list[Column]:
    """Descending with nulls first, then the key ascending so that ties have one order."""
    return [F.col(column).desc_nulls_first(), *[F.col(k).asc_nulls_last() for k in key]]


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page, as a top-k of every partition and then of all.

    Every partition sends ``offset + limit`` rows to one task, so a deep page is better asked for
    with ``page_after``. Spark knows how few rows come out and broadcasts them by that size.
    """
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, keys: dict[str, object], limit: int, descending: bool = False) -> DataFrame:
    """The page behind the row with these values of its order columns, which are not null; its
    cost does not grow with how deep it lies."""
    columns = list(keys)
    later = F.lit(False)
    for c in reversed(columns):
        beyond = F.col(c) < keys[c] if descending else F.col(c) > keys[c]
        later = beyond | ((F.col(c) == keys[c]) & later)
    order = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in columns]
    return page(df.filter(later), order, limit)
