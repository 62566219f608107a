"""Results on their way out: plain types, JSON lines, a preview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordercash.functions.plain import is_plain, plain

PREVIEW_ROWS = 50  # Fixed value: rows shown with a result.


def export_rows(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text and decimals as doubles, at any depth."""
    return df.select(
        *[
            F.col(f"`{f.name}`")
            if is_plain(f.dataType)
            else plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name)
            for f in df.schema.fields
        ]
    )


def write_json(df: DataFrame, path: str) -> None:
    export_rows(df).write.json(path)


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    return df.limit(rows)
