"""Jobs over results and messages as text: a short digest, and markdown clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordercash.functions.plain import as_text
from ordercash.functions.strings import WS, strip


def strip_markdown_tables(text: Column) -> Column:
    """Text without the lines of pipe tables and rules, and without blank lines at its end."""
    kept = F.filter(
        F.split(text, "\n"),
        lambda line: ~(strip(line).startswith("|") | strip(line).rlike(r"\A[-| ]+\z")),
    )
    return F.regexp_replace(
        F.array_join(kept, "\n"), rf"(?U)(?:\A|\n){WS}*\z", ""
    )


def _shown(df: DataFrame, column: str) -> Column:
    """A value as the digest prints it."""
    value = F.col(f"`{column}`")
    kind = df.schema[column].dataType
    text = as_text(value, kind, point=True)
    if isinstance(kind, T.BooleanType):
        text = F.initcap(text)
    return F.coalesce(text, F.lit("None"))


def result_digest(
    df: DataFrame,
    order_by: Sequence[str],
    rows: int = 5,
    columns: int | None = 6,
    mark: str = ".",
) -> DataFrame:
    """One row: the number of results, and a text showing the first few of them.

    The older form is ``rows=10, columns=None, mark=":"``.
    """
    shown = df.columns[:columns]
    line = F.concat(
        F.lit("- "),
        F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), _shown(df, c)) for c in shown]),
    )
    first = (
        df.orderBy(*order_by)
        .limit(rows)
        .select(F.struct(*order_by).alias("ord"), line.alias("line"))
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "line"))),
                                      lambda r: r.line), "\n").alias("lines"))
    )
    total = df.agg(F.count("*").alias("n_results"))
    both = total.unionByName(first, allowMissingColumns=True).agg(
        F.max("n_results").alias("n_results"), F.max("lines").alias("lines")
    )
    head = F.concat(F.lit("Found "), F.col("n_results"), F.lit(f" result(s){mark}\n"))
    return both.select(
        "n_results",
        F.when(F.col("n_results") == 0, F.lit("No matching data found."))
        .otherwise(F.concat(head, F.col("lines")))
        .alias("digest"),
    )
