"""License scan: MinHash bands over overlapping windows find templates, shingles verify them.

Words are runs of letters and digits, lower-cased; a shingle is five words in a row. A template is
cut into segments of at most ``MAX_SEGMENT`` shingles, and a segment of s/2 to s shingles is looked for
in windows of 2 s shingles that start every s, so that one window holds any place where it stands.
A band is one row, the least shingle under a seeded hash, and a window and a segment that it holds
agree on a band with at least chance ``LEAST``; ``bands`` is chosen for ``recall`` at that chance.

1. Where the texts have shingles of any template is told by a join on the shingle, and written.
2. A window's least shingle can only be a segment's if the window has a shingle of some template, so
   bands are worked out for the windows around those places alone, which loses nothing. They meet the
   bands of the segments in a join on (size, band, least shingle), which gives pairs of text and template.
3. A pair is verified exactly. With t shingles in the template, the text is cut into stretches of t; the
   template is there if ``containment`` of its shingles are in three stretches in a row.

Templates are a table of any size, written once; whether a side is broadcast is Spark's choice by the size
of the files. Nothing of it comes to the driver or stands in a plan.

Nulls: a null text has no words; a null id is an id like others; a null license is left out. Texts or
templates of fewer than five words have no shingle and match nothing. Equal rows of one id give one row, as
do several wordings of one license. An empty table of either gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordercash.llm.common import written
from ordercash.llm.license_texts import TEMPLATES

NGRAM = 5
CONTAINMENT = 0.8
MAX_SEGMENT = 16
SIZES = [2**k for k in range(int(math.log2(MAX_SEGMENT)) + 1)]
#: Jaccard of a window of 2 s shingles and a segment of over s / 2 of which it has 80 %.
LEAST = 0.8 * 0.5 / (2 + 0.2 * 0.5)
NOT_WORDS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: What tells a text of an id: two hashes of both.
TEXT = ["one", "two"]


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, whatever the optimiser moves where."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def shingles(words: Column) -> Column:
    """Hashes of five words in a row; none for fewer words."""
    last = F.size(words) - NGRAM
    return F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(NGRAM)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def words_of(text: Column) -> Column:
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), NOT_WORDS, " " * len(NOT_WORDS))
    return F.array_remove(F.split(plain, " "), "")


def bands_for(recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - LEAST))


def least_shingles(window: Column, bands: int) -> Column:
    """For each band its number and the least seeded hash of the window's shingles."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(bands)),
        lambda k: F.struct(k.alias("band"), F.array_min(F.transform(window, lambda h: F.xxhash64(k, h))).alias("least")),
    )


def template_table(spark: SparkSession, templates: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """(template, license, hashes): a number, the license and the distinct shingles of each template."""
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame(templates, "license string, text string")
    split = templates.filter(F.col("license").isNotNull()).select(
        "license", let(words_of(F.col("text")), lambda w: F.array_distinct(shingles(w))).alias("hashes")
    )
    # The number is written with its row; it is not worked out again.
    return written(
        split.filter(F.size("hashes") > 0).select(F.monotonically_increasing_id().alias("template"), "*"), "templates"
    )


def segment_bands(known: DataFrame, bands: int) -> DataFrame:
    """(template, s, band, least) of each segment; its size class s is 1, 2, 4, 8 or MAX_SEGMENT."""
    cuts = F.sequence(F.lit(1), F.size("hashes"), F.lit(MAX_SEGMENT))
    segments = known.select(
        "template", F.explode(F.transform(cuts, lambda i: F.slice("hashes", i, MAX_SEGMENT))).alias("segment")
    ).withColumn("s", F.pow(F.lit(2), F.ceil(F.log2(F.size("segment")))).cast("int"))
    return (
        segments.select("template", "s", F.explode(least_shingles(F.col("segment"), bands)).alias("b"))
        .select("template", "s", "b.band", "b.least").distinct()
    )


def window_bands(texts: DataFrame, hits: DataFrame, bands: int) -> DataFrame:
    """(one, two, s, band, least) of the windows that hold a place in ``hits``."""
    places = written(hits.groupBy(*TEXT).agg(F.collect_set("at").alias("places")), "places")

    def windows_of(hashes: Column) -> Column:
        # Two windows of each size hold a place, but for the first ones of a text. A window is told by one
        # number, since Spark compares numbers by a hash but structs one by one.
        windows = [
            F.transform(
                F.array_distinct(F.flatten(F.transform("places", lambda at: F.array(
                    F.greatest(F.floor(at / s) - 1, F.lit(0)), F.floor(at / s)  # noqa: B023
                )))),
                lambda k: F.struct(
                    F.lit(s).alias("s"),  # noqa: B023
                    F.slice(hashes, (k * s + 1).cast("int"), s * 2).alias("window"),  # noqa: B023
                ),
            )
            for s in SIZES
        ]
        return F.concat(*windows)

    found = let(words_of(F.col("text")), lambda w: let(shingles(w), windows_of))
    windows = texts.join(places, TEXT).select(*TEXT, F.explode(found).alias("w")).select(*TEXT, "w.*")
    return windows.select(*TEXT, "s", F.explode(least_shingles(F.col("window"), bands)).alias("b")).select(
        *TEXT, "s", "b.band", "b.least"
    )


def scanned(
    docs: DataFrame,
    templates: list[tuple[str, str]] | DataFrame | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    containment: float = CONTAINMENT,
    recall: float = 0.9999,
) -> DataFrame:
    """One row a document and license found: doc_id, license, containment, first_word.

    ``templates`` are (license, text) pairs or a DataFrame of these columns.
    """
    bands = bands_for(recall)
    known = template_table(docs.sparkSession, TEMPLATES if templates is None else templates)
    sizes = known.select("template", "license", F.size("hashes").alias("t"))
    held = written(known.select("template", F.explode("hashes").alias("hash")), "shingles")
    segments = written(segment_bands(known, bands), "segments")

    row = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    texts = row.select(
        F.xxhash64("doc_id", "text").alias("one"), F.xxhash64(F.lit(1), "doc_id", "text").alias("two"), "*"
    )
    every = let(words_of(F.col("text")), shingles)
    hits = written(
        texts.select(*TEXT, "doc_id", F.posexplode(every).alias("at", "hash"))
        .join(held.select("hash").distinct(), "hash", "left_semi").distinct(),
        "hits",
    )

    pairs = written(
        window_bands(texts, hits, bands).join(segments, ["s", "band", "least"]).select(*TEXT, "template").distinct(),
        "pairs",
    )

    places = hits.join(held, "hash").join(pairs, [*TEXT, "template"]).join(sizes, "template")
    stretch = F.floor(F.col("at") / F.col("t"))
    near = places.select(
        "doc_id", *TEXT, "template", "license", "t", "at", "hash",
        F.explode(F.sequence(stretch - 1, stretch + 1)).alias("stretch"),
    )
    # Distinct shingles are counted from one row each, so no group gathers its rows.
    return (
        near.groupBy("doc_id", *TEXT, "template", "license", "t", "stretch", "hash").agg(F.min("at").alias("at"))
        .groupBy("doc_id", *TEXT, "template", "license", "t", "stretch")
        .agg((F.count("*") / F.col("t")).alias("containment"), F.min("at").cast("long").alias("first_word"))
        .filter(F.col("containment") >= containment)
        .groupBy("doc_id", "license")
        .agg(F.max("containment").alias("containment"), F.min("first_word").alias("first_word"))
    )
