"""Source divergence audit: how far the wording of a source lies from that of its language.

1. Tasks tell the terms of a chunk of texts, qualified by the lang, so that one vocabulary holds that of
   every lang and no job is run per lang. In how many documents a term is, and how often in the texts of a source, are
   sums of powers of two: for each power the terms that have it are written as lists with that weight.
2. The terms of at least ``min_docs`` of a lang's documents are told by an aggregate of the first lists. CountVectorizer
   is fit on them, with no limit on their number, and makes each list of a source a sparse vector.
   The weighted vectors are summed by group (lang, source) as index and count. Only the counts a group
   has are rows; they are integers, so the sums are exact.
3. A term's smoothed share in a group is ``p = 1 + floor(1e9 (count + prior) / (N + prior V))``. All
   terms that a group doesn't have share one value, so a pair of groups is worked out from the
   counts there are: tasks take a tile of groups against a tile of groups over a block of terms.

The vocabulary passes through the driver, as CountVectorizer has it. Its size is estimated first, and it is cut
by a hash of the term into as many fits as keep each below ``fit_bytes``: terms of different fits never
meet in a sum, so the result is the same. A task holds at most two tiles of groups by a block of terms, and
a chunk of texts, or a longer one.

Nulls: a null text, lang or source is the empty one. Equal rows count each. Long texts are counted
whole. A lang without any kept term gives its pairs the value 0 and no terms; an empty table gives no
rows. Other columns, whatever their names, are left aside. One row for each other source of the lang is
what the pairs are, so their number is the square of a lang's sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordercash.llm.common import give_back, lean, ship, small_batches, written

ship(__name__)

MIN_DOCS = 30
PRIOR = 5
TOP = 50
SCALE = 1_000_000_000
#: What parts a lang from a term, and terms from each other; terms have no such characters.
BETWEEN, NEXT = "\x00", "\x01"
TILE = 256  # groups
BLOCK = 4096  # terms
SAMPLE = 64  # one of so many terms tells the size of the vocabulary
ENTRY = 64  # bytes an entry of a vocabulary takes beside the term
LIST = 8192  # terms in a list at most
#: Bytes as terms have them, 0 for those that no term has.
_FOLD = np.array(
    [b if b >= 128 or chr(b).islower() else b + 32 if chr(b).isupper() else 0 for b in range(256)], dtype=np.uint8
)
#: Lists of terms with a weight: ``seen`` by documents, ``terms`` a source's. Rows with a lang are groups.
COUNTED = pa.schema([
    ("lang", pa.string()), ("source", pa.string()), ("weight", pa.int64()),
    ("seen", pa.list_(pa.string())), ("terms", pa.list_(pa.string())),
])


def marked(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, marked) of each row, to look at. A term is a run of letters, A-Z lower-cased, and of characters
    beyond ASCII; ``marked`` is the terms, each with its lang in hex ahead of it."""
    rows = docs.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
          for c, name in ((lang, "lang"), (source, "source"), (text, "text")))
    )
    # Where all is ASCII, letters beyond A-Z can't be changed by ``lower``, which is many times faster.
    lower = F.when(F.octet_length("text") == F.char_length("text"), F.lower("text")).otherwise(
        F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )
    # What is between terms becomes the mark of the next one; a first and a last run are there always.
    mark = F.concat(F.lit(NEXT), F.hex("lang"), F.lit(BETWEEN))
    text = F.concat(F.lit(" "), lower, F.lit(" "))
    return rows.select(
        "lang", "source", F.regexp_replace(text, F.lit(r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"), mark).alias("marked")
    )


def with_terms(rows: DataFrame) -> DataFrame:
    """``marked`` as the array ``terms``; what is ahead of the first mark and behind the last is empty."""
    pieces = rows.withColumn("pieces", F.split("marked", NEXT))
    return pieces.withColumn("terms", F.slice("pieces", F.lit(2), F.size("pieces") - 2)).drop("marked", "pieces")


def _listed(words: pa.Array, names: pa.Array | None, of: np.ndarray, codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Lists of the words that stand n times with a name, or with none; what is of one name lies together."""
    for bit in range(int(n.max()).bit_length()):
        has = n >> bit & 1 == 1
        if not has.any():
            continue
        first = np.flatnonzero(np.diff(of[has], prepend=-1))
        place = np.arange(has.sum())
        starts = np.flatnonzero((place - np.repeat(first, np.diff(first, append=len(place)))) % LIST == 0)
        lists = pa.ListArray.from_arrays(np.append(starts, len(place)).astype(np.int32), words.take(pa.array(codes[has])))
        none, nameless = pa.nulls(len(starts), lists.type), pa.nulls(len(starts), pa.string())
        sources = nameless if names is None else names.take(pa.array(of[has][starts]))
        seen, terms = (lists, none) if names is None else (none, lists)
        weight = pa.array(np.full(len(starts), 1 << bit))
        yield pa.record_batch([nameless, sources, weight, seen, terms], schema=COUNTED)


def _count_chunk(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The lists of a chunk of texts, each with a blank behind it, and the chunk's groups."""
    groups = rows.select(["lang", "source"]).group_by(["lang", "source"]).aggregate([])
    none = [pa.nulls(len(groups), COUNTED.field(c).type) for c in ("weight", "seen", "terms")]
    yield from pa.table([*groups.columns, *none], schema=COUNTED).to_batches()
    lang, source = (pc.dictionary_encode(rows.column(c).combine_chunks()) for c in ("lang", "source"))
    texts = rows.column("text").cast(pa.large_string()).combine_chunks()
    _, ends, raw = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = _FOLD[np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]]]
    letter = raw != 0
    edges = np.flatnonzero(np.diff(letter, prepend=False))
    begin, size = edges[::2], edges[1::2] - edges[::2]
    told = pa.LargeStringArray.from_buffers(
        len(begin), pa.py_buffer(np.concatenate([[0], np.cumsum(size)])), pa.py_buffer(raw[letter])
    ).dictionary_encode()
    terms, code = told.dictionary.cast(pa.string()), told.indices.to_numpy()
    n_terms = np.diff(np.searchsorted(begin, ends - ends[0]))
    del texts, raw, letter, edges, begin, size, told
    if not len(code):
        return
    key, n = np.unique(np.repeat(np.arange(len(n_terms)), n_terms) << 32 | code, return_counts=True)
    text, code = key >> 32, key & 0xFFFFFFFF

    # Terms with their langs.
    pair, code = np.unique(lang.indices.to_numpy()[text].astype(np.int64) << 32 | code, return_inverse=True)
    hexed = pa.array([x.encode().hex().upper() for x in lang.dictionary.to_pylist()], pa.string())
    words = pc.binary_join_element_wise(
        hexed.take(pa.array(pair >> 32)), terms.take(pa.array(pair & 0xFFFFFFFF)), BETWEEN
    )
    yield from _listed(words, None, np.zeros(len(pair), np.int64), np.arange(len(pair)), np.bincount(code))
    key = source.indices.to_numpy()[text].astype(np.int64) << 32 | code
    by = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[by], prepend=-1))
    key, n = key[by][first], np.add.reduceat(n[by], first)
    yield from _listed(words, source.dictionary, key >> 32, key & 0xFFFFFFFF, n)


def _count(chunk_bytes: int):
    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column("text").nbytes
            if size >= chunk_bytes:
                chunk, held, size = pa.Table.from_batches(held), [], 0
                yield from _count_chunk(chunk)
                del chunk
                give_back()
        if held:
            yield from _count_chunk(pa.Table.from_batches(held))

    return count


def counted(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", chunk_bytes: int = 12 << 20
) -> DataFrame:
    """Texts as lists of terms (``COUNTED``), ``chunk_bytes`` of them together."""
    small_batches(docs.sparkSession)
    rows = docs.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
          for c, name in ((lang, "lang"), (source, "source"), (text, "text")))
    )
    return rows.withColumn("text", F.concat(F.make_valid_utf8("text"), F.lit(" "))).mapInArrow(
        _count(chunk_bytes), "lang string, source string, weight long, seen array<string>, terms array<string>"
    )


def kept_terms(rows: DataFrame, min_docs: int) -> DataFrame:
    """The terms, with their langs, of at least ``min_docs`` documents."""
    return (
        rows.filter("seen IS NOT NULL").select("weight", F.explode("seen").alias("term"))
        .groupBy("term").agg(F.sum("weight").alias("n")).filter(F.col("n") >= min_docs).select("term")
    )


def fits_needed(kept: DataFrame, fit_bytes: int) -> int:
    """Into how many fits the vocabulary is cut, told from a ``SAMPLE``th of the terms, drawn by a hash."""
    drawn = kept.filter(F.pmod(F.xxhash64("term"), F.lit(SAMPLE)) == 0)
    size = drawn.agg(F.sum(F.octet_length("term") + ENTRY)).first()[0] or 0
    return max(1, -(-size * SAMPLE // fit_bytes))


def vectors(rows: DataFrame, min_docs: int = MIN_DOCS, fit_bytes: int = 256 << 20):
    """For each fit, its number, the sources' lists with a sparse ``vector``, and the vocabulary (index, lang, term)."""
    spark = rows.sparkSession
    kept = written(kept_terms(rows, min_docs), "kept")
    lists = rows.filter("terms IS NOT NULL").select("source", "weight", "terms")
    fits = fits_needed(kept, fit_bytes)
    # A vocabulary must not be empty: a mark that no term is stands in it.
    mark = spark.range(1).select(F.array(F.lit(BETWEEN)).alias("terms"))
    for fit in range(fits):
        part, terms = lists, kept.select(F.array("term").alias("terms"))
        if fits > 1:
            part, terms = (
                df.withColumn("terms", F.filter("terms", lambda t: F.pmod(F.xxhash64(t, F.lit(fits)), F.lit(fits)) == fit))
                for df in (part, terms)
            )
        model = CountVectorizer(
            inputCol="terms", outputCol="vector", minDF=1.0, vocabSize=2**31 - 1, binary=True
        ).fit(terms.unionAll(mark))
        cells = [(i, *t.split(BETWEEN)) for i, t in enumerate(model.vocabulary) if t != BETWEEN]
        index, langs, words = zip(*cells, strict=True) if cells else ((), (), ())
        vocabulary = pa.table({
            "index": pa.array(index, pa.int64()),
            "lang": pa.array([bytes.fromhex(x).decode() for x in langs], pa.string()),
            "term": pa.array(words, pa.string()),
        })
        yield fit, model.transform(part).drop("terms"), spark.createDataFrame(vocabulary)


def group_sums(rows: DataFrame, *group: str) -> DataFrame:
    """Weights of the lists' vectors summed by group, one row for each index that a group has."""
    return (
        rows.select(*group, "weight", F.explode(F.unwrap_udt("vector")["indices"]).alias("index"))
        .groupBy(*group, F.col("index").cast("long").alias("index")).agg(F.sum("weight").alias("n"))
    )


def share(count: Column, total: Column, kept: Column, prior: int) -> Column:
    """1 + floor(SCALE (count + prior) / (total + prior kept)), exact at any size."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + prior).cast("decimal(20,0)")
    return F.call_function("div", above, (total + prior * kept).cast("decimal(20,0)")) + 1


def _tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of |p - q| over a block of terms between the groups of two tiles."""
    lang, a, b, _ = key
    marks = rows[rows["id"] < 0]
    cells = rows[rows["id"] >= 0]
    names, rest_p = marks["source"].to_numpy(), marks["p"].to_numpy(np.int64)
    ids, at = np.unique(cells["id"].to_numpy(), return_inverse=True)
    p = np.repeat(rest_p[:, None], len(ids), axis=1)
    p[pd.Index(names).get_indexer(cells["source"]), at] = cells["p"].to_numpy(np.int64)
    rest = int(marks["terms"].iloc[0]) - len(ids)
    tile = marks["tile"].to_numpy()
    left, right = np.flatnonzero(tile == a), np.flatnonzero(tile == b)
    one, two, values = [], [], []
    for i in left:
        value = np.abs(p[right] - p[i]).sum(axis=1) + rest * np.abs(rest_p[right] - rest_p[i])
        other = right != i
        one.append(np.full(other.sum(), i))
        two.append(right[other])
        values.append(value[other])
    none = np.zeros(0, dtype=np.int64)
    one, two, value = (np.concatenate([none, *found]) for found in (one, two, values))
    if a != b:
        one, two, value = np.append(one, two), np.append(two, one), np.append(value, value)
    names = names.astype(object)
    return pd.DataFrame({"lang": lang, "source": names[one], "item": names[two], "value": value})


def audit(
    docs: DataFrame,
    text_column: str = "text",
    lang_column: str = "lang",
    source_column: str = "source",
    min_docs: int = MIN_DOCS,
    prior: int = PRIOR,
    top: int = TOP,
    fit_bytes: int = 256 << 20,
    tile: int = TILE,
    block: int = BLOCK,
    chunk_bytes: int = 12 << 20,
) -> DataFrame:
    """(lang, source, part, item, value, rank): the distance to each other source of the lang (part
    ``pair``), and the ``top`` terms that a source has more of than its lang (part ``term``)."""
    spark = docs.sparkSession
    rows = written(counted(docs, text_column, lang_column, source_column, chunk_bytes), "terms")
    counts = spark.createDataFrame([], "source string, id long, n long")
    words = spark.createDataFrame([], "id long, lang string, term string")
    for fit, vectored, vocabulary in vectors(rows, min_docs, fit_bytes):
        number = F.lit(fit * 2**31) + F.col("index")
        counts = counts.unionByName(
            # An index is a lang's own.
            written(group_sums(vectored, "source"), "sums").select("source", number.alias("id"), "n")
        )
        words = words.unionByName(written(vocabulary, "vocabulary").select(number.alias("id"), "lang", "term"))
    counts = counts.join(words.select("id", "lang"), "id")

    # Totals: of groups, of langs, of terms in a lang.
    kept = words.groupBy("lang").agg(F.count("*").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = written(
        rows.filter("lang IS NOT NULL").select("lang", "source").distinct()
        .join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
        .select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v"))),
        "groups",
    )
    langs = groups.groupBy("lang", "v").agg(F.sum("total").alias("total"), F.count("*").alias("sources"))
    in_lang = written(
        counts.groupBy("id").agg(F.sum("n").alias("n")).join(words, "id").join(langs, "lang")
        .select("id", "term", "lang", share(F.col("n"), F.col("total"), F.col("v"), prior).alias("q")),
        "terms_of_langs",
    )
    cells = written(
        counts.join(groups, ["lang", "source"])
        .select("lang", "source", "id", share(F.col("n"), F.col("total"), F.col("v"), prior).alias("p")),
        "cells",
    )

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = (
        cells.join(in_lang.drop("lang"), "id").filter(F.col("p") > F.col("q"))
        .select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    )

    tiles = F.ceil(F.col("sources") / tile)
    placed = groups.join(langs.select("lang", "sources"), "lang").select(
        "lang", "source", "v", "total", tiles.alias("tiles"), F.pmod(F.xxhash64("source"), tiles).alias("tile")
    )
    blocks = in_lang.groupBy("lang", F.floor(F.col("id") / block).alias("block")).agg(F.count("*").alias("terms"))
    marks = placed.join(blocks, "lang").select(
        "lang", "source", "tiles", "tile", "block", F.lit(-1).cast("long").alias("id"), "terms",
        share(F.lit(0), F.col("total"), F.col("v"), prior).alias("p"),
    )
    valued = cells.join(placed.select("lang", "source", "tiles", "tile"), ["lang", "source"]).select(
        "lang", "source", "tiles", "tile", F.floor(F.col("id") / block).alias("block"), "id",
        F.lit(0).cast("long").alias("terms"), "p",
    )
    dealt = marks.unionByName(valued).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    ).select(
        "lang", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "block",
        "source", "tile", "id", "terms", "p",
    )
    pairs = (
        dealt.groupBy("lang", "a", "b", "block")
        .applyInPandas(_tile, "lang string, source string, item string, value long")
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    )
    bare = groups.filter("v = 0")
    pairs = pairs.unionByName(
        bare.select("lang", "source").join(bare.select("lang", F.col("source").alias("item")), "lang")
        .filter(F.col("source") != F.col("item")).withColumn("value", F.lit(0).cast("long"))
    ).withColumn("rank", F.row_number().over(best))

    shape = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    return (
        pairs.withColumn("part", F.lit("pair")).select(shape)
        .unionByName(over.withColumn("part", F.lit("term")).select(shape))
    )
