"""Benchmark decontamination with a generalised suffix automaton.

The words of all benchmark items go into one automaton (a *generalised* one: built item after item,
each from the root). Streaming a document's words through it gives, at every word, the length of
the longest run of words ending there that occurs in some item. A run of ``window`` words or more
means that a window of the item ends here; an item shorter than a window counts as a whole, which
its end states tell. Hit spans are the unions of those windows.

Items are dealt by a hash into blocks of some ``block_words`` words, which Spark writes to the shared folder;
neither the driver nor a broadcast holds an item. A Python worker reads a block's files and builds its
automaton once, whatever number of tasks it runs, and holds one at a time. With one block that is one map
stage. With more, rows are numbered and written once, every block is a pass over them that writes the spans
it found, and spans and items of all passes are put together by row number. Items of equal words share
one entry of an automaton, so a state has at most one short item of each length below ``window``.

Nulls: a null text has no words; a null item id is an item named "". Items and documents without
words hit nothing. Equal items are each counted. Empty tables give no rows, or no hits.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from types import ModuleType

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordercash.llm.common import fresh_path, lean, ship, written

ship(__name__)

WINDOW = 13
#: Coverage from which a document counts as contaminated: one word in so many.
COVERAGE = 20

#: Bytes of words: digits, letters and all beyond ASCII; A-Z are lower-cased.
_WORD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 32
    for c in range(256)
)
_WORD_IN_TEXT = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORD).split()


class Automaton:
    """Suffix automaton over the word sequences of many items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int, int]]] = [[]]  # (entry, place, words) ending in a state
        entries: dict[bytes, int] = {}
        self.names: list[list[str]] = []  # of the items that share an entry
        for name, ws in items:
            k = entries.setdefault(b" ".join(ws), len(entries))
            if k < len(self.names):
                self.names[k].append(name)
                continue
            self.names.append([name])
            last = 0
            for place, w in enumerate(ws):
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                while len(ends) < len(self.next):
                    ends.append([])
                ends[last].append((k, place + 1, len(ws)))
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        # Where a state's string of ``window`` words lies: itself or one up the links. It holds the
        # entries of all states below it; each state hands its own up to there.
        self.home = [-1] * len(self.next)
        self.short: list[list[tuple[int, int]]] = [[] for _ in self.next]  # (words, entry), whole
        found: list[set[int]] = [set() for _ in self.next]
        for v in order[1:]:
            up = self.link[v]
            if self.length[v] >= window:
                self.home[v] = self.home[up] if self.length[up] >= window else v
        for v in order[1:]:
            if self.home[v] >= 0:
                found[self.home[v]].update(k for k, _, n in ends[v] if n >= window)
            whole = [(n, k) for k, place, n in ends[v] if place == n < window]
            # An item's own end state may also hold longer strings that end alike; the item is
            # hit once as many words match as it has.
            self.short[v] = sorted(set(whole) | set(self.short[self.link[v]]))
        self.found = [tuple(x) for x in found]

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        cur = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def match(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans as (first word, word after the last), disjoint and in order; items hit."""
        spans: list[tuple[int, int]] = []
        hit: set[int] = set()
        state, matched, window = 0, 0, self.window
        step, link, length, home, short = self.next, self.link, self.length, self.home, self.short
        for place, c in enumerate(map(self.vocabulary.get, ws)):
            if c is None:
                state = matched = 0
                continue
            while state and c not in step[state]:
                state = link[state]
                matched = length[state]
            to = step[state].get(c)
            if to is None:
                matched = 0
                continue
            state = to
            matched += 1
            covers = 0
            if matched >= window:
                covers = window
                hit.update(self.found[home[state]])
            for n, k in short[state]:
                if n <= matched:
                    covers = max(covers, n)
                    hit.add(k)
            if covers:
                first = place + 1 - covers
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, place + 1))
        return spans, {name for k in hit for name in self.names[k]}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    at = [m.span() for m in _WORD_IN_TEXT.finditer(text)]
    out, end = [], 0
    for a, b in spans:
        out.append(text[end : at[a][0]])
        end = at[b - 1][1]
    return "".join(out) + text[end:]


def blocks(benchmark: DataFrame, item_column: str, text_column: str, block_words: int) -> tuple[str, int]:
    """The folder that the items with words are written to as (item, text, block), and how many blocks."""
    rows = benchmark.select(
        F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    ).withColumn("words", F.regexp_count("text", F.lit(_WORD_IN_TEXT.pattern)))
    count = max(1, -(-(rows.agg(F.sum("words")).first()[0] or 0) // block_words))
    folder = fresh_path(benchmark.sparkSession, "items")
    # By item and text: neither a text nor an id that many rows share makes a block large.
    block = F.pmod(F.xxhash64("item", "text"), F.lit(count)).alias("block")
    kept = rows.filter("words > 0").select("item", "text", block)
    kept.repartition(count, "block").write.partitionBy("block").parquet(folder)
    return folder, count


def automaton_of(folder: str, block: int, window: int) -> Automaton:
    """The automaton of a written block. A worker keeps the last one it built, in a module of its own, as
    this one is sent anew with every task."""
    kept = sys.modules.setdefault("_kept_automaton", ModuleType("_kept_automaton")).__dict__
    if kept.get("key") != (folder, block, window):
        from pyarrow import fs, parquet

        kept.pop("key", None)
        kept.pop("automaton", None)
        store, root = fs.FileSystem.from_uri(folder)
        files = store.get_file_info(fs.FileSelector(f"{root}/block={block}", allow_not_found=True))
        items = []
        for path in sorted(f.path for f in files if f.base_name.endswith(".parquet") and f.base_name[0] not in "._"):
            with store.open_input_file(path) as file:
                for batch in parquet.ParquetFile(file).iter_batches(columns=["item", "text"]):
                    columns = batch.to_pydict()
                    items += zip(columns["item"], map(words, columns["text"]), strict=True)
        kept["automaton"] = Automaton(items, window)
        kept["key"] = (folder, block, window)
    return kept["automaton"]


_SPANS = T.ArrayType(T.ArrayType(T.LongType()))
_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("spans", _SPANS),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("clean_text", T.StringType()),
])


def _told(text: str | None, n_words: int, spans: list, items: list[str], coverage: int, cleaned: bool) -> tuple:
    n_hit = sum(b - a for a, b in spans)
    cut = cleaned and n_hit and coverage * n_hit >= n_words
    return n_words, n_hit, [[a, b] for a, b in spans], items, without(text, spans) if cut else None


def _one_pass(text: Column, folder: str, window: int, coverage: int, cleaned: bool) -> Column:
    @F.pandas_udf(_FOUND)
    @lean
    def matched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = automaton_of(folder, 0, window)
        for texts in batches:
            rows = []
            for text in texts:
                ws = words(text)
                spans, items = automaton.match(ws)
                rows.append(_told(text, len(ws), spans, sorted(items), coverage, cleaned))
            yield pd.DataFrame(rows, columns=_FOUND.names)

    return matched(text)


def _a_pass(text: Column, folder: str, block: int, window: int) -> Column:
    @F.pandas_udf(T.StructType([_FOUND["spans"], _FOUND["items"]]))
    @lean
    def matched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = automaton_of(folder, block, window)
        for texts in batches:
            found = [automaton.match(words(text)) for text in texts]
            yield pd.DataFrame({
                "spans": [[[a, b] for a, b in spans] for spans, _ in found],
                "items": [list(items) for _, items in found],
            })

    return matched(text)


def _together(text: Column, spans: Column, items: Column, coverage: int, cleaned: bool) -> Column:
    @F.pandas_udf(_FOUND)
    def put(texts: pd.Series, spans: pd.Series, items: pd.Series) -> pd.DataFrame:
        rows = []
        for text, s, x in zip(texts, spans, items, strict=True):
            of_row = merged([(int(a), int(b)) for a, b in s]) if s is not None else []
            names = sorted(set(x)) if x is not None else []
            rows.append(_told(text, len(words(text)), of_row, names, coverage, cleaned))
        return pd.DataFrame(rows, columns=_FOUND.names)

    return put(text, spans, items)


def hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW,
    coverage: int = COVERAGE,
    block_words: int = 1_000_000,
    cleaned: bool = False,
) -> DataFrame:
    """``docs`` in a struct ``record`` with n_words, n_hit, spans, items and ``contaminated``.

    ``cleaned`` adds the text without its spans. With one block only the text goes to Python. Writes the items
    when called, and with more than one block the numbered rows and what each pass finds.
    """
    folder, count = blocks(benchmark, item_column, item_text_column, block_words)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"))
    text = F.col("record").getField(text_column)
    if count == 1:
        found = rows.select("record", _one_pass(text, folder, window, coverage, cleaned).alias("found"))
    else:
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
        passes = fresh_path(docs.sparkSession, "passes")
        for block in range(count):
            in_block = rows.select("row", _a_pass(text, folder, block, window).alias("f")).select("row", "f.*")
            in_block.filter(F.size("spans") > 0).write.parquet(f"{passes}/block={block}")
        schema = T.StructType([T.StructField("row", T.LongType()), _FOUND["spans"], _FOUND["items"]])
        of_rows = (
            docs.sparkSession.read.schema(schema).parquet(passes).groupBy("row")
            .agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("x"))
        )
        found = rows.join(of_rows, "row", "left").select(
            "record", _together(text, F.col("s"), F.col("x"), coverage, cleaned).alias("found")
        )
    found = found.select("record", "found.*")
    return found.withColumn(
        "contaminated",
        (F.col("n_hit") > 0) & (F.col("n_hit") * coverage >= F.col("n_words")),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """``docs`` with the hit spans cut out of contaminated documents; a document left without a
    word is dropped, and all others are as they were. ``n_chars``, if there, follows the text."""
    found = hits(docs, benchmark, text_column, cleaned=True, **options)
    found = found.filter(~F.col("contaminated") | (F.col("n_hit") < F.col("n_words")))
    text = F.coalesce(F.col("clean_text"), F.col("record").getField(text_column))
    columns = {c: F.col("record").getField(c) for c in docs.columns}
    columns[text_column] = text
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.col("clean_text").isNull(), columns["n_chars"]).otherwise(
            F.length(text)
        ).cast(kind)
    return found.select(*[v.alias(c) for c, v in columns.items()])


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
