"""Host-level quality rules.

A document fails by its own rules; hosts are judged by how often their documents fail. The rate of
a host is shrunk towards the rate of all hosts with a beta prior fitted to the hosts' rates by
moments, so a host of few documents is judged by its few documents only a little. Documents of a
host whose shrunk rate exceeds ``max_rate`` are rejected with it.

Nulls: a null text has no words and fails; a null host is a host of its own. Empty table: no rows.
Equal rows are rows like others. Columns of the input are not carried on, so none can clash; the
verdicts come with the id, and ``accepted`` filters the input itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordercash.llm.common import SPACES, spread, written

#: Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
NULL_HOST = "\x00"


def words_of(text: Column) -> Column:
    """Runs of characters other than white space; none for a null text."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(plain, " "), "")


def with_repeat_words(df: DataFrame, window: int) -> DataFrame:
    """``df`` with n_repeat_words: words in windows of ``window`` of its ``words`` that are found
    twice or more in the text.

    Windows are hashed; only where two are equal are they sorted with their places, so that equal
    ones lie side by side. Each step is a column of its own, so that it is worked out once a row.
    """
    n = F.size("words")
    hashes = F.transform(
        F.sequence(F.lit(0), n - window),
        lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(window)]),
    )
    out = df.withColumn("_hashes", F.when(n > window, hashes))
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    placed = F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    out = out.withColumn("_rows", F.when(repeats, F.array_sort(placed)))
    rows = F.col("_rows")
    twice = F.filter(
        rows,
        lambda r, k: (r["h"] == F.get(rows, k - 1)["h"]) | (r["h"] == F.get(rows, k + 1)["h"]),
    )
    out = out.withColumn("_starts", F.array_sort(F.transform(twice, lambda r: r["i"])))
    starts = F.col("_starts")
    covered = F.transform(
        starts,
        lambda i, k: F.least(F.lit(window), F.coalesce(F.get(starts, k + 1) - i, F.lit(window))),
    )
    total = F.coalesce(F.aggregate(covered, F.lit(0), lambda x, y: x + y), F.lit(0))
    return out.withColumn("n_repeat_words", total.cast("long")).drop("_hashes", "_rows", "_starts")


def rule_figures(docs: DataFrame, id_column="doc_id", text_column="text", host_column="source") -> DataFrame:
    """One row a document: its figures, ``base_failed`` and its host."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    split = docs.select(
        F.col(id_column).alias("doc_id"),
        F.coalesce(F.col(host_column).cast("string"), F.lit(NULL_HOST)).alias("host"),
        text.alias("text"),
        words_of(text).alias("words"),
    )
    figures = with_repeat_words(split, WINDOW).select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )
    return figures.withColumn("base_failed", failed)


def host_verdicts(figures: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """One row a host: documents, failures, shrunk rate and whether it is rejected.

    The prior's mean m is the failure rate over all documents. Its strength s = a + b is fitted by
    moments: with hosts' rates weighted by their documents, the spread beyond binomial noise is
    m (1 - m) / (s + 1). No spread beyond noise gives the greatest strength, ``1e6``.
    """
    hosts = figures.groupBy("host").agg(
        F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")
    )
    rate = F.col("failed") / F.col("n")
    sums = hosts.agg(
        F.sum("n").alias("docs"),
        F.sum("failed").alias("fails"),
        F.sum(F.col("failed") * rate).alias("squares"),
        F.count("*").alias("hosts"),
    )
    mean = F.coalesce(F.col("fails") / F.col("docs"), F.lit(0.0))
    prior = sums.select(
        mean.alias("mean"),
        # Weighted variance of rates, less what drawing n documents a host makes by itself.
        (
            (F.col("squares") - F.col("docs") * mean * mean - (F.col("hosts") - 1) * mean * (1 - mean))
            / F.greatest(F.col("docs") - F.col("hosts"), F.lit(1))
        ).alias("excess"),
    ).select(
        "mean",
        F.when(
            F.col("excess") > 0,
            F.greatest(F.least(F.col("mean") * (1 - F.col("mean")) / F.col("excess") - 1, F.lit(1e6)), F.lit(1.0)),
        ).otherwise(1e6).alias("strength"),
    )
    m, s = prior.select("mean").scalar(), prior.select("strength").scalar()
    return hosts.withColumn(
        "host_rate", (F.col("failed") + m * s) / (F.col("n") + s)
    ).withColumn("host_rejected", F.col("host_rate") > max_rate)


def judged(docs: DataFrame, max_rate: float = 0.5, **columns) -> DataFrame:
    """One row a document: figures, ``base_failed``, the host's verdict and ``kept``."""
    # Both tables are written, so that texts are read once and a short list of hosts is known by
    # its size to be one; a long list is joined by a shuffle.
    figures = written(rule_figures(docs, **columns), "figures")
    hosts = host_verdicts(figures, max_rate).select("host", "host_rate", "host_rejected")
    hosts = written(hosts, "hosts")
    joined = figures.withColumn("_spread", spread("host")).join(
        hosts.withColumn("_spread", spread("host")), ["host", "_spread"]
    )
    return joined.drop("_spread").withColumn(
        "kept", ~F.col("base_failed") & ~F.col("host_rejected")
    )


def accepted(docs: DataFrame, max_rate: float = 0.5, **columns) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    carried = docs.withColumn("_all", F.struct("*"))
    text, host = columns.get("text_column", "text"), columns.get("host_column", "source")
    verdicts = judged(carried, max_rate, id_column="_all", text_column=text, host_column=host)
    return verdicts.filter("kept").select("doc_id.*")

