"""Best-two-fit packing of token sequences.

Where a piece goes depends on its length alone, so the packing is worked out on the histogram of
lengths, which has at most ``capacity`` rows whatever the corpus: a bin is filled greedily, the
longest piece that fits first; then its smallest piece is swapped for two unpacked ones that fill
the gap it leaves more tightly, if there are any. The same bin comes out again for as long as the
lengths in it last, so bins are found as patterns with a number of times. Pieces are then numbered
within their length, in parallel, and the pattern that covers a number says bin and offset.

Nulls: a null text is the empty one, a piece of one end token. An empty table gives no rows. Equal
rows are packed each. Columns beyond id and text are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ordercash.llm.common import lean, ship, spread, written

ship(__name__)

CAPACITY = 4096
END = 1
PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, row string"
)


def byte_letters() -> dict[int, str]:
    """The letter that a byte-level tokenizer writes for each byte: printable ones stand for
    themselves, the others for the letters from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    """Token ids of texts for a tokenizer that lower-cases and never joins across white space.

    Words are encoded once and kept, up to ``keep`` of them; a text's ids are those of its words.
    A word of letters, with marks behind it or not, is one piece to the tokenizer's model (the marks
    are another), which is then asked directly; any other word goes through the whole tokenizer.
    """

    MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'")

    def __init__(self, path: str, keep: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.keep = keep

    def whole(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def word(self, raw: bytes) -> bytes:
        text = raw.decode()
        core = text.rstrip(self.MARKS)
        # Letters of one form each; a mark of a foreign alphabet behind a word is none of them.
        if not core.isalpha() or not (core.isascii() or (is_normalized("NFC", core) and core.islower())):
            return self.whole(text)
        marks = text[len(core) :]
        if marks not in self.marks:
            if len(self.marks) > 100_000:
                self.marks = {"": b""}
            self.marks[marks] = self.whole(marks)
        spelt = core if core.isascii() else core.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes() + self.marks[marks]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.known) > self.keep:
            self.known.clear()
        known, word, out = self.known, self.word, []
        for text in texts:
            ws = text.encode("utf-8", "replace").lower().split()
            for w in ws:
                if w not in known:
                    known[w] = word(w)
            out.append(b"".join([known[w] for w in ws]))
        return out


def pieces(
    docs: DataFrame,
    tokenizer: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    end: int = END,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document, its end token included."""
    keep_ids = with_ids

    @lean
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = WordEncoder(tokenizer)
        last = array("I", [end]).tobytes()
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            for at in range(0, len(texts), 256):
                rows = []
                for doc, row, ids in zip(
                    batch["doc_id"][at : at + 256], batch["row"][at : at + 256],
                    encoder.encode(texts[at : at + 256]), strict=True,
                ):
                    ids += last
                    for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + capacity)]
                        rows.append((
                            doc, k, start, len(part) // 4, zlib.crc32(part),
                            np.frombuffer(part, dtype="<i4") if keep_ids else None, row,
                        ))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "row"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    slim = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"),
        # Tells rows apart that have the same id and text.
        F.monotonically_increasing_id().cast("string").alias("row"),
    )
    return slim.mapInPandas(cut, PIECES)


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Best-two-fit over lengths and how many there are of each: (times, lengths of the bin)."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    out = []
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return out
        bin_: list[int] = []
        gap = capacity
        there = np.flatnonzero(left)
        while gap and len(there):
            at = int(np.searchsorted(there, gap, side="right")) - 1
            if at < 0:
                break
            x = int(there[at])
            take = min(int(left[x]), gap // x)
            bin_ += [x] * take
            left[x] -= take
            gap -= take * x
            there = there[:at]
        if gap and len(bin_) > 1:
            small = bin_[-1]
            left[small] += 1
            two = _best_two(left, gap + small, small)
            if two:
                bin_[-1:] = two
                for x in two:
                    left[x] -= 1
            else:
                left[small] -= 1
        uses: dict[int, int] = {}
        for x in bin_:
            uses[x] = uses.get(x, 0) + 1
        more = min(int(left[x]) // n for x, n in uses.items())
        for x, n in uses.items():
            left[x] -= more * n
        out.append((1 + more, sorted(bin_, reverse=True)))


def _best_two(left: np.ndarray, room: int, more_than: int) -> list[int] | None:
    """Two lengths at hand whose sum is the largest up to ``room`` and over ``more_than``."""
    there = np.flatnonzero(left[: room + 1])
    if not len(there):
        return None
    mate = np.searchsorted(there, room - there, side="right") - 1
    ok = mate >= 0
    a, b = there[ok], there[mate[ok]]
    # The same length twice needs two of it; else the next shorter one is its mate.
    lone = (a == b) & (left[a] < 2)
    place = mate[ok] - lone
    keep = place >= 0
    a, b = a[keep], there[place[keep]]
    if not len(a):
        return None
    best = int(np.argmax(a + b))
    pair = sorted((int(a[best]), int(b[best])), reverse=True)
    return pair if sum(pair) > more_than else None


def _layout(capacity: int):
    """Rows (length, first, n, per, bin, offset): the pieces of this length numbered from ``first``
    on, ``n`` of them, go ``per`` to a bin from ``bin`` on, the first of a bin at ``offset``."""

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"length": [], "n": []}, dtype="int64"), *batches])
        used: dict[int, int] = {}
        bin_, out = 0, []
        for times, lengths in patterns(dict(zip(rows["length"], rows["n"], strict=True)), capacity):
            offset = at = 0
            while at < len(lengths):
                x = lengths[at]
                per = lengths.count(x)
                first = used.get(x, 0)
                out.append((x, first, times * per, per, bin_, offset))
                used[x] = first + times * per
                at += per
                offset += per * x
            bin_ += times
        yield pd.DataFrame(out, columns=["length", "first", "n", "per", "bin", "offset"])

    return lay


def packed(cut: DataFrame, capacity: int = CAPACITY, part_rows: int = 1_000) -> DataFrame:
    """``cut`` (see ``pieces``; it is read three times, so let it be a written table) with
    ``sequence_id`` and ``offset``. A length's pieces are numbered in parts of ``part_rows``."""
    # At most ``capacity`` rows, and so safe to broadcast.
    histogram = written(cut.groupBy("length").agg(F.count("*").alias("n")), "lengths")
    parts = histogram.select("length", F.ceil(F.col("n") / part_rows).alias("parts"))
    numbered = cut.join(F.broadcast(parts), "length").withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.col("parts"))
    ).drop("parts")
    counts = numbered.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "row")
    ranked = (
        numbered.withColumn("place", F.row_number().over(within) - 1)
        .join(starts, ["length", "part"])
        .withColumn("number", F.col("base") + F.col("place"))
    )
    schema = "length long, first long, n long, per long, bin long, offset long"
    # At most one row a length: one task holds them all.
    bins = histogram.coalesce(1).mapInPandas(_layout(capacity), schema)
    bins = written(bins, "bins")
    # A length's bins come as one sorted list; a number's bin is the last that starts at or before.
    runs = bins.groupBy("length").agg(
        F.array_sort(F.collect_list(F.struct("first", "per", "bin", "offset"))).alias("runs")
    )
    placed = ranked.withColumn("_spread", spread("length")).join(
        runs.withColumn("_spread", spread("length")), ["length", "_spread"]
    )
    run = F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("number")), -1)
    return (
        placed.withColumn("run", run)
        .withColumn("nth", F.col("number") - F.col("run.first"))
        .withColumn("sequence_id", F.col("run.bin") + F.floor(F.col("nth") / F.col("run.per")))
        .withColumn("offset", F.col("run.offset") + F.col("nth") % F.col("run.per") * F.col("length"))
        .drop("runs", "run", "nth", "number", "place", "base", "part", "_spread")
    )


def sequences(placed: DataFrame) -> DataFrame:
    """One row a sequence with its token ids, from pieces that carry theirs (``with_ids``)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(parts["ids"]).alias("ids"))


